"""Answers between question headings are whole by default."""

from pyspark.sql import functions as F

from siteglass.operators import structured_data as Q


def test_answers_are_whole_and_take_in_other_headings(spark):
    long = "word " * 400
    html = f"<h2>What is it?</h2><p>{long}</p><h3>Part</h3><p>more</p><h2>Who?</h2><p>somebody else</p><h2>Plain</h2>end"
    frame = spark.createDataFrame([(html,), ("<h2>What is it?</h2>only one",), ("<p>x</p>",)], "html string")
    rows = frame.select(F.expr(Q._question_answers()).alias("qa")).collect()
    assert [(r.question, r.answer) for r in rows[0].qa] == [("What is it?", f"{long.strip()} Part more"), ("Who?", "somebody else Plain end")]
    assert rows[1].qa == [] and rows[2].qa == []
    cut = frame.select(F.expr(Q._question_answers(most=500)).alias("qa")).first().qa
    assert [len(r.answer) for r in cut] == [500, len("somebody else Plain end")]
