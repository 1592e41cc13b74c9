"""Seeded pseudo-random draws as expressions, the same in every engine and on every executor.

A draw is the first eight hexadecimal digits of an MD5 over the seed and a key, so resamples,
permutations and subsets need no generator state, survive lost executors unchanged, and can be
repeated in plain SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def draw(*keys: Column | int | str) -> Column:
    """A whole number below 2^32 for keys joined by dashes."""
    text = F.concat_ws("-", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def positions(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the place (from 1) of each row in its group by ``order``.

    Unlike a window over the whole table, no task gets all rows: rows are sorted into ranges, and
    each range adds the counts of the ranges before it. The order should be total, else ties are
    placed in any order. The sorted rows are stored once, so ranges stay what they are.
    """
    group = group or []
    sorted_ = df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("_part", F.spark_partition_id())
    sorted_ = stored(sorted_, "positions")
    within = Window.partitionBy("_part", *group).orderBy(*order)
    counts = sorted_.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_part", *group)])
    placed = sorted_.withColumn("_k", F.row_number().over(within)).alias("l").join(base.alias("r"), same)
    return placed.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_k") + F.col("_base")).cast("long").alias(name))


def nested_subset(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The first ``round(n * fraction)`` rows of one seeded permutation, so fractions are nested."""
    n = df.count()
    shuffled = positions(df.withColumn("_d", draw(seed, F.col(key))), ["_d", key], name="_rank")
    return shuffled.where(F.col("_rank") <= int(n * fraction + 0.5)).drop("_d", "_rank")


def stratified_subset(df: DataFrame, label: str, key: str, fraction: float, seed: int) -> DataFrame:
    """``round(n_label * fraction)`` rows, one at least, of each label."""
    quota = df.groupBy(label).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(float(fraction)) + F.lit(0.5))).alias("_quota"))
    shuffled = positions(df.withColumn("_d", draw(seed, F.col(key))), ["_d", key], [label], "_rank")
    return shuffled.join(F.broadcast(quota), label).where(F.col("_rank") <= F.col("_quota")).select(*df.columns)


def shuffled_partner(df: DataFrame, key: str, seed: int, within: list[str] | None = None) -> DataFrame:
    """``key, partner``: a seeded permutation of the keys, over all rows or within groups."""
    within = within or []
    keys = df.select(key, *within)
    left = positions(keys, [key], within, "_rank")
    right = positions(keys.withColumn("_d", draw(seed, F.col(key))), ["_d", key], within, "_rank").select(F.col(key).alias("partner"), *within, "_rank")
    return left.join(right, [*within, "_rank"]).select(key, "partner")


def multiplicities(df: DataFrame, rank: str, n: int, draws: int, seed: int = 0) -> DataFrame:
    """``draw, row, n``: how often a bootstrap of n rows takes each row (never the rows themselves)."""
    spark = df.sparkSession
    slots = spark.range(draws * n).select(F.floor(F.col("id") / n).cast("long").alias("draw"), (F.col("id") % n).alias("slot"))
    taken = slots.select("draw", F.pmod(draw(F.col("draw") + seed, F.col("slot")), F.lit(n)).alias("row"))
    return taken.groupBy("draw", "row").agg(F.count("*").alias("n"))
