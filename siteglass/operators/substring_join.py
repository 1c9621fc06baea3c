"""Joins on "one text contains the other" without comparing every pair.

Hay texts are indexed by their pieces of ANCHOR characters with places; shorter needles have shorter pieces of their own. Pieces
are counted first. A needle with a piece that no hay has is in none of them; any other is looked up by its rarest piece, and the
next rarest must stand at the right distance from it. So needles with a common ending, or a common beginning, meet only those
hays that share what is rare in them. A piece of many hays is cut into blocks of about BLOCK places. Counts are written before they are joined, so that adaptive execution splits hot pieces. Candidates are numbers of
texts; the texts are joined back for them and checked in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.session import cut_lineage

ANCHOR = 8
BLOCK = 10_000


def _pieces(text: str, lengths: str) -> str:
    """Array of the pieces of `text` of the given lengths with their places."""
    return (
        f"flatten(transform(filter(array({lengths}), q -> q > 0 AND q <= length({text})), "
        f"q -> transform(sequence(1, length({text}) - q + 1), i -> named_struct('gram', substring({text}, i, q), 'at', i))))"
    )


def candidates(needles: DataFrame, hays: DataFrame, block: int = BLOCK) -> DataFrame:
    """(needle_no, hay_no) that may hold. needles: needle_no, needle; hays: hay_no, hay; no empty texts."""
    of_needle = needles.select("needle_no", F.explode(F.expr(_pieces("needle", f"least(length(needle), {ANCHOR})"))).alias("p")).select("needle_no", "p.*")
    # At most ANCHOR lengths exist; texts are only indexed by those in use.
    used = needles.select(F.expr(f"least(length(needle), {ANCHOR}) AS q")).distinct().collect()
    lengths = ", ".join(str(r.q) for r in used) or "0"
    of_hay = hays.select("hay_no", F.explode(F.expr(_pieces("hay", lengths))).alias("p")).select("hay_no", "p.*")
    wanted = cut_lineage(of_needle.groupBy("gram").agg(F.count("*").alias("needles")))
    of_hay = cut_lineage(of_hay.join(wanted, "gram", "left_semi"))
    places = of_hay.groupBy("gram").agg(F.count("*").alias("places"))
    counts = cut_lineage(places.withColumn("blocks", F.expr(f"cast(ceil(places / {block}) AS int)")))

    rarest = Window.partitionBy("needle_no").orderBy(F.asc_nulls_first("places"), "at")
    ranked = of_needle.join(counts, "gram", "left").withColumn("place", F.row_number().over(rarest)).where("place <= 2")
    anchors = ranked.groupBy("needle_no").agg(
        *[F.max(F.when(F.col("place") == n, F.struct("gram", "at", "places", "blocks"))).alias(name) for n, name in ((1, "first"), (2, "second"))]
    ).where("first.places IS NOT NULL")
    anchors = anchors.select(
        "needle_no", F.col("first.gram").alias("gram"), F.col("first.at").alias("offset"), F.col("second.gram").alias("gram2"),
        (F.col("second.at") - F.col("first.at")).alias("distance"), F.explode(F.expr("sequence(0, first.blocks - 1)")).alias("block"),
    )
    index = of_hay.join(counts, "gram").select("hay_no", "gram", "at", F.expr("cast(pmod(xxhash64(hay_no, at), blocks) AS int)").alias("block"))

    met = index.join(anchors, ["gram", "block"]).select("needle_no", "hay_no", "gram2", (F.col("at") + F.col("distance")).alias("at2"))
    second = of_hay.select("hay_no", F.col("gram").alias("gram2"), F.col("at").alias("at2"))
    both = met.where("gram2 IS NOT NULL").join(second, ["hay_no", "gram2", "at2"], "left_semi")
    return met.where("gram2 IS NULL").unionByName(both).select("needle_no", "hay_no").distinct()


def contained_in(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """All (needle, hay) with needle inside hay. needles: needle; hays: hay; both distinct; empty texts are left out."""
    numbered = lambda df, text: cut_lineage(df.where(f"{text} <> ''").select(F.monotonically_increasing_id().alias(f"{text}_no"), text))
    wanted, texts = numbered(needles, "needle"), numbered(hays, "hay")
    found = candidates(wanted, texts).join(texts, "hay_no").join(wanted, "needle_no")
    return found.where("contains(hay, needle)").select("needle", "hay")
