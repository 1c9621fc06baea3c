"""Domains of all answers against brute force."""

import re

from siteglass.plans.catalog import registered

BARE = r"(?ia)\b([a-z0-9-]+\.(?:com|cn|net|org|com\.cn|io|dev|ai|so|hk))\b"


def test_domains_in_the_texts_are_read(spark, tmp_path):
    texts = [
        "plain words", "read https://www.news.example.net/a and Shop.DE or blog.dev", "HTTP://up.org, http://a.b.hk:80/x", "mail me@host.ai", None, "no.",
        "https://www.d1.example.com twice https://www.d1.example.com",
    ]
    rows = [(conv, 1 + i, "assistant", text) for conv in (1, 11, 13, 15) for i, text in enumerate(texts)] + [(1, 90, "user", "ask at site.com")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    expected = set()
    for conv, turn, role, text in rows:
        if role != "assistant" or text is None or conv in (11, 13):
            continue  # refused and very short answers name no domain
        answer = f"{text} See [guide {turn}](https://www.d{conv % 7}.example.com/p{turn}) and www.ref{turn % 5}.org/x. Also https://d{conv % 3}.co.uk/a) or shop.io here"
        hosts = [re.sub(r"^www\.", "", h) for h in re.findall(r"https?://([a-zA-Z0-9.-]+)", answer)]
        expected |= {(conv, turn, domain) for domain in hosts + [d.lower() for d in re.findall(BARE, answer)]}
    queries = registered()[0]
    found = [tuple(r) for r in queries["whole_answer_domains"](spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    named = {r.domain for r in queries["answer_domains"](spark, str(tmp_path)).collect()}
    assert {"news.example.net", "blog.dev", "a.b.hk", "host.ai", "up.org"} <= {d for *_, d in found} - named
