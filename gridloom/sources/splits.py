"""Split manifests: text files with a file name a line, named after their split.

The class of a file is its name up to the last underscore; its label is the place of the class in
sorted order (or in an order given).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The ten classes in label order, and the sizes of the splits.
CLASSES_10 = (
    "AnnualCrop", "Forest", "HerbaceousVegetation", "Highway", "Industrial",
    "Pasture", "PermanentCrop", "Residential", "River", "SeaLake",
)
SIZES_10 = {"train": 16200, "val": 5400, "test": 5400}
SIZES_45 = {"train": 18900, "val": 6300, "test": 6300}


def class_of(name):
    return F.regexp_extract(name, r"([^/]*)_[^_/]*$", 1)


def read_splits(spark: SparkSession, paths: dict[str, str], classes: Iterable[str] | None = None) -> DataFrame:
    """``filename, class, label, split`` of the files named for each split; blank lines do not count."""
    parts = [spark.read.text(path).select(F.trim("value").alias("filename"), F.lit(split).alias("split")).where(F.col("filename") != "") for split, path in paths.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("class", class_of(F.col("filename")))
    return with_labels(rows, classes)


def with_labels(rows: DataFrame, classes: Iterable[str] | None = None) -> DataFrame:
    """``rows`` with ``label``; a class that is not among those given is an error when checked."""
    names = sorted(r["class"] for r in rows.select("class").distinct().collect()) if classes is None else list(classes)
    labels = rows.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "class string, label int")
    return rows.join(F.broadcast(labels), "class", "left").select("filename", "class", "label", "split")


def split_faults(rows: DataFrame, sizes: dict[str, int] | None = None) -> list[str]:
    """What is wrong with a manifest: sizes, repeated names (within or across splits), unknown classes."""
    faults = []
    counts = {r["split"]: r for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("unknown")).collect()}
    for split, n in (sizes or {}).items():
        found = counts[split]["n"] if split in counts else 0
        if found != n:
            faults.append(f"{split} has {found} files, not {n}")
    faults += [f"{s} has {r['unknown']} files of unknown classes" for s, r in sorted(counts.items()) if r["unknown"]]
    repeated = rows.groupBy("filename").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n")).first()["n"]
    if repeated:
        faults.append(f"{repeated} files are listed more than once")
    return faults


def check_splits(rows: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    faults = split_faults(rows, sizes)
    if faults:
        raise ValueError("; ".join(faults))
    return rows


def split_by_number(df: DataFrame, key: str, parts: int = 5, val: int = 3, test: int = 4) -> DataFrame:
    """``df`` with ``split`` by the key's remainder: val, test, and train for all other remainders."""
    k = F.col(key) % parts
    return df.withColumn("split", F.when(k == val, "val").when(k == test, "test").otherwise("train"))
