"""Topics of titles: a title is cut once per query, and a domain counts once per topic whatever titles it has."""

import random

from siteglass.operators import query_intelligence as M


def test_topic_gap_cuts_a_title_once_and_counts_domains_once(spark, monkeypatch):
    draw = random.Random(7)
    words = ["oak", "Oak", "pine", "fir tree", "elm", "ash"]
    titles = [None, "", " - ", "alone"] + [" - ".join(draw.choices(words, k=3)) for _ in range(6)]
    rows = [(draw.choice(["q1", "q2", None]), draw.choice(titles), draw.choice(["a", "b", "c", "d", None])) for _ in range(90)]
    rows += [("one", "oak - birch", d) for d in ["a", "a", "b", "c", None]] * 40
    cut = []

    def spy(df, *args, explode=M.explode_rows, **named):
        cut.append(df.count())
        return explode(df, *args, **named)

    monkeypatch.setattr(M, "explode_rows", spy)
    own = ["Big OAK chair", "red pine", "x"]
    found = M.topic_gap(spark.createDataFrame(rows, "query string, title string, domain string"), spark.createDataFrame([(t,) for t in own], "title string"))
    domains = {}
    for query, title, domain in rows:
        for topic in (title or "").replace("-", " ").split():
            domains.setdefault((query, topic), set()).add(domain)
    expected = []
    for (query, topic), seen in domains.items():
        held = any(topic.lower() in t.lower() for t in own)
        if len(seen) >= 2 and (not held or len(seen) >= 3):
            expected.append((query, topic, len(seen), "partial" if held else "none"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str) and len(expected) > 10
    assert cut == [len({(query, title) for query, title, _ in rows})]
