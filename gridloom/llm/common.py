"""Shared plumbing of the text operators.

Conventions every operator of this package keeps:

* An operator selects only the columns it needs first, so extra columns of the input (whatever
  their names) never clash with the ones it makes.
* A null text is read as the empty text. Rows, not ids, are the unit of work: inside an operator
  a row is named by ``rid`` (``monotonically_increasing_id`` taken once and written to a table),
  so null or repeated ids neither fail nor merge rows.
* What is used by several later plans is written to the shared folder of
  ``spark.checkpoint.dir`` and read again; this cuts lineage in a way that outlives executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input that one task of a shuffle is meant to hold, where the input's size is known.
PART_BYTES = 64 << 20
#: A key with more than 1 / HUBS of all rows is a hub; there are fewer than HUBS of them.
HUBS = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Everything that is not a digit, an ASCII letter or a code point beyond ASCII, after lower-casing.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (local tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read again.

    The table is deleted when the application ends, or before by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _place(spark, path)
    fs.deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._gridloom_path = path
    return back


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def release(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that no later plan reads."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        where, fs = _place(df.sparkSession, path)
        fs.delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Plans run inside hand Python at most ``rows`` rows at once, where rows hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Plans run inside delete their shuffle files as soon as they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parts(df: DataFrame, factor: float = 1.0) -> int:
    """Partitions to deal ``factor`` times the bytes of ``df`` over: those of the session, or more
    where the size that Spark knows of its files asks for more."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size > 1 << 55 else max(least, int(size * factor) // PART_BYTES)  # above: Spark's mark of an unknown size


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` (a stored table) with the least ``value`` of all rows of the same ``key``.

    Minima are pre-aggregated in every task. Rows of hubs get theirs by a broadcast of fewer than
    ``HUBS`` rows and are not dealt by key, so no task gets more than a small share of the rows.
    """
    low = materialize(rows.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("key rows")), "least")
    total = low.agg(F.sum("key rows")).first()[0] or 0
    hubs = low.where(F.col("key rows") * HUBS > total).select(key, F.col(name).alias("hub least"))
    marked = rows.join(F.broadcast(hubs), key, "left")
    rest = marked.where(F.col("hub least").isNull()).drop("hub least").join(low.select(key, name), key)
    return rest.unionByName(marked.where(F.col("hub least").isNotNull()).withColumnRenamed("hub least", name))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(text, UPPER, LOWER)


def words_with_end(text: Column) -> Column:
    """Words of the lower-cased text followed by one empty string, which marks the end."""
    cut = F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK)
    return F.concat(F.array_remove(cut, ""), F.array(F.lit("")))


def word_positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per word and one end row per document: ``rid, doc_id, n_words, pos, w0, w1, w2``.

    ``w1`` and ``w2`` are the next words: ``''`` just past the last one and null beyond. It is a
    narrow plan (scan, split, generate) that stays in one stage.
    """
    return (
        docs.select(F.col(id_col).alias("doc_id"), words_with_end(F.col(text_col)).alias("ws"))
        .select(F.monotonically_increasing_id().alias("rid"), "doc_id", "ws")
        # outer: else Catalyst infers a filter on size(ws) below the generator and splits twice
        .select("rid", "doc_id", "ws", F.posexplode_outer("ws").alias("pos", "w0"))
        .select(
            "rid",
            "doc_id",
            (F.size("ws") - 1).cast("long").alias("n_words"),
            F.col("pos").cast("long").alias("pos"),
            "w0",
            F.get("ws", F.col("pos") + 1).alias("w1"),
            F.get("ws", F.col("pos") + 2).alias("w2"),
        )
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
