"""Tables on disk: test tables, stored intermediate results, feature caches, text and JSON files.

Everything goes through Spark's readers and the file system of the path, so any store that Spark
reaches will do. Files made on the driver are written beside their place and renamed into it.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import math
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); local sessions get a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _scratch[app] = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _scratch[app], ignore_errors=True)
    return "file://" + _scratch[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: short lineage that outlives executors.

    The table is deleted when the application ends.
    """
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _place(df.sparkSession, path)
    fs.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- small files ----------------------------------------------------------------------------


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _place(spark, path)
    return bool(fs.exists(where))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all."""
    where, fs = _place(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(where):
        fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"could not move {beside} to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _place(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def plain(value: Any) -> Any:
    """JSON-ready: scores that are not finite become null, numbers of other libraries plain ones."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def to_json(value: Any) -> str:
    """The same text for the same content: sorted keys, no floats that JSON does not know."""
    return json.dumps(plain(value), sort_keys=True, indent=2, allow_nan=False) + "\n"


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, to_json(value))


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))


def fingerprint(value: Any) -> str:
    """Hash of the JSON form of a specification."""
    return hashlib.sha256(to_json(value).encode()).hexdigest()


def content_fingerprint(df: DataFrame) -> str:
    """Hash of a table's rows, whatever their order and partitioning (a sum of row hashes)."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(row).alias("s")).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{r['n']}|{r['s']}".encode()).hexdigest()


# --- sinks ----------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty table is refused, as is a nested column."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    if nested:
        raise ValueError(f"CSV has no nested columns: {nested}")
    if df.isEmpty():
        raise ValueError("nothing to write")
    df.write.mode("overwrite").option("header", True).csv(path)


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """One table of several whose columns differ; what a table lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


class FeatureCache:
    """Feature vectors in Parquet by variant and split, with a manifest that says what they are."""

    def __init__(self, spark: SparkSession, path: str, identity: dict[str, Any]):
        self.spark, self.path, self.identity = spark, path.rstrip("/"), plain(identity)

    def write(self, features: DataFrame) -> None:
        """Rows need ``variant`` and ``split``; the manifest is written last."""
        features.write.mode("overwrite").partitionBy("variant", "split").parquet(f"{self.path}/features")
        back = self.spark.read.parquet(f"{self.path}/features")
        rows = {f"{r['variant']}/{r['split']}": r["n"] for r in back.groupBy("variant", "split").agg(F.count("*").alias("n")).collect()}
        write_json(self.spark, f"{self.path}/manifest.json", {"identity": self.identity, "rows": rows, "content": content_fingerprint(back)})

    def read(self, verify: bool = False) -> DataFrame:
        """The cached rows; another identity than that of the manifest is an error."""
        if not exists(self.spark, f"{self.path}/manifest.json"):
            raise FileNotFoundError(f"{self.path} has no manifest")
        manifest = read_json(self.spark, f"{self.path}/manifest.json")
        if manifest["identity"] != self.identity:
            raise ValueError("the cache was made for another specification")
        rows = self.spark.read.parquet(f"{self.path}/features")
        if verify and content_fingerprint(rows) != manifest["content"]:
            raise ValueError("the cache's rows have changed")
        return rows
