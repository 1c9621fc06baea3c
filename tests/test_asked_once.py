"""Questions of titles and answers: texts without a question are left out before the others are trimmed, links are not listed for a status."""

from siteglass.operators import answers as A
from siteglass.operators import query_intelligence as M


def test_questions_are_found_before_texts_are_trimmed(spark):
    items = spark.createDataFrame(
        [("q", "e", 1, "　Why? ﻿"), ("q", "e", 1, "Why?"), ("q", "e", 2, "Why?"), ("q", "e", 3, "plain"), ("q", "e", 4, None), (None, "e", 5, "哪种 "), ("q", "e", 6, " ")],
        "query string, engine string, position int, title string",
    )
    answers = ["See https://a.test/x 。 如何选择  ？如何?plain text here! " + "x" * 197 + "多少。" + "x" * 198 + "多少", None, "no link 如何选择", "www.b.test 如何选择"]
    records = A.with_citations(spark.createDataFrame([("q", f"m{i}", a) for i, a in enumerate(answers)], "query string, model string, answer string"))
    found = M.related_questions(items, records)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2  # a title's and a sentence's; not once more for every question word
    assert "aggregate(" not in plan.replace("Aggregate", "")  # no places of links
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted([("q", "Why?", 2, "serp:e:pos=1"), (None, "哪种", 1, "serp:e:pos=5"), ("q", "如何选择", 1, "ai:m0:answer"), ("q", "x" * 197 + "多少", 1, "ai:m0:answer"), ("q", "www.b.test 如何选择", 1, "ai:m3:answer")], key=str)
    assert [r.citations_status for r in records.orderBy("model").collect()] == ["ok", "unavailable", "unavailable", "ok"]
