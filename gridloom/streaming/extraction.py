"""Feature extraction over a stream of patches.

Extraction keeps no state from patch to patch, so the batch operator runs unchanged on a stream;
there is no event time and no watermark to set. Each micro-batch is appended exactly once by the
file sink.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract
from ..plans.features import FeaturePlan


def patch_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream of patches; the schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def extract_stream(patches: DataFrame, plans: FeaturePlan | Mapping[str, FeaturePlan], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the vectors of a stream to Parquet; ``once`` ends when what is there has been read."""
    writer = extract(patches, plans).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
