"""Sums of outer products over all rows: what ridge maps, principal components and CKA are made of.

A pass over the rows adds up ``x' y`` per task; the task sums are added in two steps (within
about the square root of their number first), so no task gets all of them. What reaches the
driver is one p x q matrix, whose size depends on the widths alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widest matrix (in values) that is collected: 256 MB of doubles.
MAX_VALUES = 1 << 25


def gram_rows(df: DataFrame, x: str, y: str) -> DataFrame:
    """``i, v``: row i of the sum of ``x' y``; ``v`` is an array as wide as y."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if not len(b):
                continue
            a, c = (np.stack(b[k].to_numpy()).astype(np.float64) for k in ("a", "c"))
            total = a.T @ c if total is None else total + a.T @ c
        if total is not None:
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "i": np.arange(len(total)), "v": list(total)})

    parts = df.select(F.col(x).alias("a"), F.col(y).alias("c")).mapInPandas(partial, "part int, i int, v array<double>")

    return add_parts(parts)


def add_parts(parts: DataFrame) -> DataFrame:
    """``i, v``: the sums of arrays ``part, i, v`` by i, first among about the root of the parts."""

    def added(key: list[str]):
        def add(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{k: [group[k].iloc[0]] for k in key}, "v": [np.sum(np.stack(group["v"].to_numpy()), axis=0)]})

        return add

    step = F.floor(F.sqrt("part")).cast("int")
    once = parts.withColumn("part", step).groupBy("part", "i").applyInPandas(added(["part", "i"]), "part int, i int, v array<double>")
    return once.groupBy("i").applyInPandas(added(["i"]), "i int, v array<double>")


def gram(df: DataFrame, x: str, y: str) -> np.ndarray:
    """The matrix itself, on the driver."""
    rows = gram_rows(df, x, y)
    shape = df.select(F.max(F.size(x)).alias("p"), F.max(F.size(y)).alias("q")).first()
    if not shape["p"]:
        raise ValueError("no rows")
    if shape["p"] * shape["q"] > MAX_VALUES:
        raise ValueError(f"a {shape['p']} x {shape['q']} matrix is too large for the driver")
    out = np.zeros((shape["p"], shape["q"]))
    for r in rows.toLocalIterator():
        out[r["i"]] = r["v"]
    return out


def gram_sql(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """``i, j, v`` of the same sums as a relational plan (a join of exploded rows by key)."""
    a = df.select(key, F.posexplode(x).alias("i", "a"))
    b = df.select(key, F.posexplode(y).alias("j", "b"))
    return a.join(b, key).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
