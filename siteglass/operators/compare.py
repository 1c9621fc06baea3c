"""Comparison of the own domain with competitors over five dimensions, in long form.

`subjects` has domain and is_own (one own row). Measures are computed per domain
by grouping; nothing is collected per competitor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteglass.functions import text as X
from siteglass.functions import urls as U
from siteglass.functions.rows import explode_rows
from siteglass.operators.answers import USABLE

# Gap sizes above which a gap is high or medium.
GAP_LEVELS = {"serp": (5, 2), "ai": (20, 10), "geo": (20, 10), "protocol": (20, 10), "schema": (3, 1)}


def compare_serp(items: DataFrame, subjects: DataFrame) -> DataFrame:
    """Mean position per engine, then over engines, one decimal each; engines that list the domain."""
    first = items.groupBy("query", "engine", "domain").agg(F.min("position").alias("position"))
    per_engine = first.join(subjects, "domain").groupBy("domain", "engine").agg(F.expr(X.half_up_1("avg(position)")).alias("rank"))
    per_domain = per_engine.groupBy("domain").agg(
        F.expr(X.half_up_1("avg(rank)")).alias("average_rank"), F.count("*").alias("engines_covered")
    )
    return subjects.join(per_domain, "domain", "left").selectExpr(
        "domain", "is_own", "average_rank", "coalesce(engines_covered, 0) AS engines_covered"
    )


def compare_ai(records: DataFrame, subjects: DataFrame) -> DataFrame:
    """Mentions, citations, mean citation position and models; own mentions come from the flag, others from the list."""
    usable = records.where(USABLE)
    # There is one own domain; its name becomes a constant instead of a join on a constant.
    own_row = subjects.where("is_own").select("domain").first()
    flagged = usable.where("mentioned").groupBy("model").agg(F.count("*").alias("mentions"))
    own = flagged.select(F.lit(own_row.domain if own_row else None).cast("string").alias("domain"), "model", "mentions")
    named = explode_rows(
        usable, f"array_distinct(transform(competitors_mentioned, c -> {U.registrable_domain('lower(trim(c))')}))", "domain", "model"
    ).join(subjects.where("NOT is_own"), "domain").groupBy("domain", "model").agg(F.count("*").alias("mentions"))
    links = explode_rows(usable, "citations", "c", "model").selectExpr(
        "model", f"{U.registrable_domain('c.url')} AS domain", "c.position AS position"
    ).join(subjects, "domain")
    cited = links.groupBy("domain", "model").agg(F.count("*").alias("citations"), F.sum("position").alias("_sum"), F.count("position").alias("_n"))
    mentioned = own.unionByName(named)
    per_domain = mentioned.join(cited, ["domain", "model"], "full_outer").groupBy("domain").agg(
        F.sum("mentions").alias("mentions"), F.sum("citations").alias("citations"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"),
        F.count_distinct("model").alias("models"),
    )
    zero = "cast(0 AS bigint)"
    return subjects.join(per_domain, "domain", "left").selectExpr(
        "domain", "is_own", f"coalesce(mentions, {zero}) AS mentions", f"coalesce(citations, {zero}) AS citations",
        f"CASE WHEN _n > 0 THEN {X.half_up_1('_sum / _n')} END AS average_position", f"coalesce(models, {zero}) AS models",
    )


USABLE_AUDIT = "http_status > 0 AND http_status < 400"


def compare_geo(audits: DataFrame, subjects: DataFrame) -> DataFrame:
    """Mean score over usable audits; blocked when there are audits but none usable."""
    per_domain = audits.groupBy("domain").agg(
        F.count("*").alias("_all"), F.expr(f"count_if({USABLE_AUDIT})").alias("usable"),
        F.expr(X.half_up_1(f"avg(CASE WHEN {USABLE_AUDIT} THEN geo_score END)")).alias("average_score"),
    )
    status = "CASE WHEN _all IS NULL THEN 'unavailable' WHEN usable > 0 THEN 'available' ELSE 'blocked' END"
    return subjects.join(per_domain, "domain", "left").selectExpr("domain", "is_own", "average_score", f"{status} AS status")


def compare_geo_dimensions(audits: DataFrame, subjects: DataFrame) -> DataFrame:
    rows = explode_rows(audits.where(USABLE_AUDIT), "breakdown", "d", "domain").join(subjects, "domain")
    return rows.groupBy("domain", F.col("d.id").alias("dimension")).agg(F.expr(X.half_up_1("avg(d.score)")).alias("score"))


def compare_protocol(protocol: DataFrame, subjects: DataFrame) -> DataFrame:
    """Openness, guide presence and score, blocked agents. protocol: domain and the columns of the protocol table."""
    return subjects.join(protocol, "domain", "left").selectExpr(
        "domain", "is_own", "openness", "guide_exists", "guide_score", "size(blocked) AS blocked_agents",
        "CASE WHEN openness IS NULL THEN 'unavailable' ELSE 'available' END AS status",
    )


def compare_schema(pages: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct structured-data types per domain and how many of the own types it lacks, and the reverse."""
    types = explode_rows(pages, "jsonld_types", "schema_type", "domain").distinct().join(subjects, "domain")
    own = types.where("is_own").select("schema_type", F.lit(True).alias("_own"))
    marked = types.join(own, "schema_type", "left")
    per_domain = marked.groupBy("domain").agg(
        F.count("*").alias("type_count"), F.expr("count_if(_own IS NULL)").alias("missing_on_own_side")
    )
    zero = "cast(0 AS bigint)"
    return subjects.join(per_domain, "domain", "left").selectExpr(
        "domain", "is_own", f"coalesce(type_count, {zero}) AS type_count", f"coalesce(missing_on_own_side, {zero}) AS missing_on_own_side"
    )


def dimension_values(
    serp: DataFrame | None = None, ai: DataFrame | None = None, geo: DataFrame | None = None,
    protocol: DataFrame | None = None, schema: DataFrame | None = None,
) -> DataFrame:
    """Long form: dimension, domain, is_own, value. A null value means no data (for ranks: not listed)."""
    parts = {
        "serp": (serp, "average_rank"), "ai": (ai, "mentions + citations"), "geo": (geo, "average_score"),
        "protocol": (protocol, "openness"), "schema": (schema, "type_count"),
    }
    frames = [
        df.selectExpr(f"'{name}' AS dimension", "domain", "is_own", f"cast({value} AS double) AS value")
        for name, (df, value) in parts.items() if df is not None
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


ABSENT = "(own IS NULL OR (dimension = 'geo' AND own = 0))"
# From the own value and the rivals' least and largest: one pass over the values, no join.
VERDICT = (
    "CASE WHEN dimension IN ('ai', 'schema') AND coalesce(own, 0) = 0 AND _nonzero = 0 THEN 'incomparable' "
    f"WHEN {ABSENT} AND _known = 0 THEN 'incomparable' WHEN {ABSENT} THEN 'behind' WHEN _known = 0 THEN 'ahead' "
    "WHEN CASE WHEN dimension = 'serp' THEN _least < own ELSE _most > own END THEN 'behind' "
    "WHEN CASE WHEN dimension = 'serp' THEN _most > own ELSE _least < own END THEN 'ahead' ELSE 'parity' END"
)
OWN_VALUE = "max(CASE WHEN is_own THEN value END)"
RIVALS = {
    "_known": "count(CASE WHEN NOT is_own THEN value END)",
    "_nonzero": "count_if(NOT is_own AND value <> 0)",
    "_least": "min(CASE WHEN NOT is_own THEN value END)",
    "_most": "max(CASE WHEN NOT is_own THEN value END)",
}


def gap_verdict(values: DataFrame) -> DataFrame:
    """behind, ahead, parity or incomparable per dimension that has an own row and rivals."""
    per_dimension = values.groupBy("dimension").agg(
        F.expr(OWN_VALUE).alias("own"), F.expr("count_if(is_own) > 0 AND count_if(NOT is_own) > 0").alias("_both"),
        *[F.expr(sql).alias(name) for name, sql in RIVALS.items()],
    )
    return per_dimension.where("_both").selectExpr("dimension", "own", f"{VERDICT} AS verdict")


def _beside_dimension(values: DataFrame) -> DataFrame:
    """Each value with its dimension's own value and verdict; a dimension has one row per compared domain."""
    same = Window.partitionBy("dimension")
    found = values.withColumns({"own": F.expr(OWN_VALUE).over(same), **{name: F.expr(sql).over(same) for name, sql in RIVALS.items()}})
    both = F.expr("count_if(is_own)").over(same) * F.expr("count_if(NOT is_own)").over(same) > 0
    return found.withColumn("verdict", F.when(both, F.expr(VERDICT))).drop(*RIVALS)


def gap_list(values: DataFrame) -> DataFrame:
    """Dimensions the own domain is behind in: leading competitors, widest gap and severity.

    A domain that is not ranked at all has no measurable rank gap and yields no row, as a rank needs both sides.
    """
    better = "CASE WHEN dimension = 'serp' THEN value < own ELSE value > own END"
    leading = _beside_dimension(values).where("verdict = 'behind' AND NOT is_own").where(
        f"value IS NOT NULL AND ({better} OR (own IS NULL AND dimension <> 'serp'))"
    )
    gap = F.expr("CASE WHEN own IS NULL THEN 999D ELSE abs(value - own) END")
    summed = leading.withColumn("_gap", gap).groupBy("dimension").agg(
        F.count("*").alias("leading"), F.max("_gap").alias("max_gap"), F.max_by("domain", F.struct("_gap", "domain")).alias("widest")
    )
    level = lambda i: "CASE dimension " + " ".join(f"WHEN '{d}' THEN {v[i]}" for d, v in GAP_LEVELS.items()) + " END"
    severity = f"CASE WHEN max_gap > {level(0)} THEN 'high' WHEN max_gap > {level(1)} THEN 'medium' ELSE 'low' END"
    return summed.selectExpr("dimension", "leading", "widest", "max_gap", f"{severity} AS severity")


def competitor_report(values: DataFrame) -> DataFrame:
    """All values with the verdict of their dimension."""
    return _beside_dimension(values).selectExpr(
        "dimension", "domain", "is_own", "value", "CASE WHEN value IS NULL THEN 'unavailable' ELSE 'available' END AS status", "verdict"
    )
