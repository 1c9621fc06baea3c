"""Row helpers for DataFrames: exploding derived arrays and spreading small inputs."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteglass.session import cut_lineage

def explode_rows(df: DataFrame, values: str, alias: str, *keep: str, position: str | None = None) -> DataFrame:
    """One row per array member, with the columns `keep`.

    Uses the outer form and drops the empty rows afterwards: the plain form makes
    Spark add a filter on the array, push it to the scan and evaluate the whole
    derivation of the array twice.
    """
    if position:
        out = df.select(*keep, F.posexplode_outer(F.expr(values)).alias(position, alias))
    else:
        out = df.select(*keep, F.explode_outer(F.expr(values)).alias(alias))
    return out.where(F.col(alias).isNotNull())


#: Number of keys, those with most rows, that a join treats apart; every other key has at most 1/HEAVY_KEYS of all rows.
HEAVY_KEYS = 1000
SALTS = 4096


def attach_by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """Left join of `rows` with `keyed` (one row per key; `count` is its number of rows) in which no task gets a heavy key.

    Spark's own skew handling does not split a join whose other side is an aggregate. Here the HEAVY_KEYS keys with most
    rows are broadcast, and their rows take a salt, by `spread`, that matches nothing in the shuffled join; so they are
    dealt evenly. Rows with a null key match nothing and are dealt evenly too.
    """
    values = [c for c in keyed.columns if c not in keys]
    heavy = keyed.orderBy(F.desc(count), *keys).limit(HEAVY_KEYS).select(
        *[F.col(k).alias(f"_heavy_{k}") for k in keys], F.struct(F.lit(True), *values).alias("_heavy")
    )
    light = keyed.select(
        *[F.col(k).alias(f"_light_{k}") for k in keys], F.lit(0).alias("_light_salt"), F.struct(F.lit(True), *values).alias("_light")
    )
    same = lambda side: [F.col(k) == F.col(f"_{side}_{k}") for k in keys]
    filled = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    salt = F.when(F.col("_heavy").isNull() & filled, 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    salted = rows.join(F.broadcast(heavy), same("heavy"), "left").withColumn("_salt", salt)
    joined = salted.join(light, [*same("light"), F.col("_salt") == F.col("_light_salt")], "left")
    found = F.coalesce("_heavy", "_light")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in values])


def attach_written(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join of `rows` with `keyed` (one row per key), which is written first.

    Beside a written table adaptive execution splits partitions of any join key, null keys included; beside an aggregate it
    does not. Nothing is sorted or broadcast for it; `attach_by_key` is for sides that are not worth writing.
    """
    return rows.join(cut_lineage(keyed), keys, how)


def held_by_key(rows: DataFrame, key: str, held: DataFrame, spread: Column) -> DataFrame:
    """Left semi join of `rows` with the keys of `held`, without a task that gets a heavy key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows")).join(held.select(key).distinct(), key, "left_semi")
    return attach_by_key(rows, counts, [key], "_rows", spread).where("_rows IS NOT NULL").drop("_rows")


_fences = count()


def fence(df: DataFrame) -> DataFrame:
    """Keep filters on derived columns above their derivation; column pruning still passes.

    A filter pushed through a long projection chain repeats the whole derivation in its condition, once per use.
    Observing a row count is the plan boundary that stops this at no cost.
    """
    return df.observe(f"siteglass_rows_{next(_fences)}", F.count(F.lit(1)).alias("rows"))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share when the input has fewer splits than cores; large inputs are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
