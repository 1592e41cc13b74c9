"""Embeddings of frozen models as tables: ``key, label, split, features``, checked when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embedding_faults(rows: DataFrame, width: int | None = None, sizes: dict[str, int] | None = None) -> list[str]:
    """What is wrong with a table of embeddings; one pass for all counts and one for repeated keys."""
    v = F.col("features")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.coalesce(F.size(v), F.lit(0))
    by = rows.groupBy("split").agg(
        F.count("*").alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.count_if(F.col("label").isNull()).alias("unlabelled")
    )
    found = {r["split"]: r for r in by.collect()}  # a row a split
    faults = []
    for split, n in (sizes or {}).items():
        have = found[split]["n"] if split in found else 0
        if have != n:
            faults.append(f"{split} has {have} rows, not {n}")
    widths = {w for r in found.values() for w in (r["lo"], r["hi"])}
    if len(widths) > 1 or (width is not None and widths - {width}):
        faults.append(f"vectors have widths {sorted(widths)}" + (f", not {width}" if width is not None else ""))
    faults += [f"{s}: {r['bad']} vectors that are not finite" for s, r in sorted(found.items()) if r["bad"]]
    faults += [f"{s}: {r['unlabelled']} rows without a label" for s, r in sorted(found.items()) if r["unlabelled"]]
    repeated = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).first()["n"]
    if repeated:
        faults.append(f"{repeated} keys are repeated")
    return faults


def read_embeddings(spark: SparkSession, path: str, width: int | None = None, sizes: dict[str, int] | None = None) -> DataFrame:
    """A checked table of embeddings; anything wrong with it is an error that names all faults."""
    rows = spark.read.parquet(path).select("key", "label", "split", F.col("features").cast("array<double>").alias("features"))
    faults = embedding_faults(rows, width, sizes)
    if faults:
        raise ValueError(f"{path}: " + "; ".join(faults))
    return rows
