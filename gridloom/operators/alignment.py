"""Key-safe alignment of feature tables, and row-wise operations on vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _not_finite(v: Column) -> Column:
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def alignment_report(left: DataFrame, right: DataFrame, key: str = "key", label: str = "label", vector: str = "features") -> DataFrame:
    """One row of counts that must all be zero for a one-to-one alignment of two tables.

    ``duplicate_left, duplicate_right, only_left, only_right, label_mismatch, not_finite``; one
    exchange by key for each side, which a following join by key can use as well.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(key).agg(
            F.count("*").alias(f"n_{tag}"), F.min(label).alias(f"lo_{tag}"), F.max(label).alias(f"hi_{tag}"), F.sum(_not_finite(F.col(vector)).cast("long")).alias(f"bad_{tag}")
        )

    both = side(left, "l").join(side(right, "r"), key, "full_outer")
    count = lambda c: F.count_if(c)
    differ = ~(F.col("lo_l").eqNullSafe(F.col("lo_r")) & F.col("hi_l").eqNullSafe(F.col("hi_r")))
    return both.agg(
        count(F.col("n_l") > 1).alias("duplicate_left"),
        count(F.col("n_r") > 1).alias("duplicate_right"),
        count(F.col("n_r").isNull()).alias("only_left"),
        count(F.col("n_l").isNull()).alias("only_right"),
        count(F.col("n_l").isNotNull() & F.col("n_r").isNotNull() & differ).alias("label_mismatch"),
        F.coalesce(F.sum(F.coalesce("bad_l", F.lit(0).cast("long")) + F.coalesce("bad_r", F.lit(0).cast("long"))), F.lit(0).cast("long")).alias("not_finite"),
    )


def align(left: DataFrame, right: DataFrame, key: str = "key", label: str = "label", vector: str = "features", names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``key, label`` and both vectors, for tables that agree on keys and labels; else an error."""
    faults = {k: v for k, v in alignment_report(left, right, key, label, vector).first().asDict().items() if v}
    if faults:
        raise ValueError(f"tables do not align: {faults}")
    return left.select(key, label, F.col(vector).alias(names[0])).join(right.select(key, F.col(vector).alias(names[1])), key)


def inner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides with the same key (the alignment of tables known to agree)."""
    return left.join(right, key)


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the left side whose key the right side lacks."""
    return left.join(right.select(key), key, "left_anti")


def subset(vector: Column, positions: list[int]) -> Column:
    """A vector of some positions."""
    return F.transform(F.array(*[F.lit(p) for p in positions]), lambda p: F.get(vector, p))


def concat_scaled(z: Column, h: Column, beta: float) -> Column:
    """``z`` followed by ``beta * h``."""
    return F.concat(z, F.transform(h, lambda x: F.lit(float(beta)) * x))


def position_stats(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """``pos, n, mean, std, lo, hi`` (population deviation) of a vector column, by groups if given.

    Sums are combined before the shuffle, so one row a position and task moves.
    """
    by = by or []
    e = df.select(*by, F.posexplode(vector).alias("pos", "v"))
    return e.groupBy(*by, "pos").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def class_means(train: DataFrame, vector: str = "features", label: str = "label") -> DataFrame:
    """``label, centre``: the mean vector of each class."""
    s = position_stats(train, vector, [label])
    return s.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda r: r["mean"]).alias("centre"))


def class_centered(df: DataFrame, centres: DataFrame, vector: str = "features", label: str = "label") -> DataFrame:
    """``df`` with each vector less the training mean of its class (one row a class: broadcast)."""
    return df.join(F.broadcast(centres), label).withColumn(vector, F.zip_with(vector, "centre", lambda a, b: a - b)).drop("centre")
