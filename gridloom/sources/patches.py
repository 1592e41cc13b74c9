"""Sources of patches: Parquet tables, image files, and the test vectors laid out as patches.

A patch table has ``patch_id, h, w, bands`` (``bands``: array of row-major arrays of doubles).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATCH_TYPE = "h int, w int, bands array<array<double>>"
SIDE = 16
VECTORS_A_BAND = 4  # four vectors of 64 make a band of 16 x 16


def lattice_value(e: Column) -> Column:
    """Unit-range floats as positive whole numbers, the same in any engine."""
    return F.floor(F.lit(1000.0) * (e.cast("double") + F.lit(1.0)) + F.lit(0.5)).cast("double")


def lattice_patches(embeddings: DataFrame, n_bands: int) -> DataFrame:
    """Complete 16 x 16 patches of ``n_bands`` bands from runs of consecutive vectors."""
    size = VECTORS_A_BAND * n_bands
    rows = embeddings.select(
        F.floor(F.col("vec_id") / size).cast("long").alias("patch_id"),
        (F.col("vec_id") % size).cast("int").alias("k"),
        F.transform("embedding", lattice_value).alias("v"),
    )
    return (
        rows.groupBy("patch_id")
        .agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("rows"))
        .where(F.size("rows") == size)  # the tail that fills no patch is left out
        .select(
            "patch_id",
            F.lit(SIDE).alias("h"),
            F.lit(SIDE).alias("w"),
            F.transform(
                F.sequence(F.lit(0), F.lit(n_bands - 1)),
                lambda b: F.flatten(F.transform(F.slice("rows", b * VECTORS_A_BAND + 1, F.lit(VECTORS_A_BAND)), lambda r: r["v"])),
            ).alias("bands"),
        )
    )


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """A patch table in Parquet; extra columns are kept."""
    return spark.read.parquet(path)


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """``path, h, w, bands`` of TIFF files (strips; none or deflate compression), bands in file order."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select("path", _tiff_udf()("content").alias("image")).select("path", "image.*")


def read_images(spark: SparkSession, path: str, size: int | None = None, expect: tuple[int, int] | None = None) -> DataFrame:
    """``path, h, w, bands`` (red, green, blue) of JPEG or PNG files by Spark's image source.

    ``size`` resizes each image to a square by a bilinear filter widened to the scale; ``expect``
    is the (height, width) that every file must have.
    """
    rows = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.nChannels < 3 or (expect and (r.height, r.width) != expect):
                    raise ValueError(f"{r.origin}: {r.height}x{r.width} with {r.nChannels} channels")
                x = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, 2::-1].transpose(2, 0, 1)
                x = resize_bilinear(x, size) if size else x.astype(np.float64)
                out.append((r.origin, x.shape[1], x.shape[2], [c.ravel() for c in x]))
            yield pd.DataFrame(out, columns=["path", "h", "w", "bands"])

    return rows.mapInPandas(run, f"path string, {PATCH_TYPE}")


def resize_bilinear(x: np.ndarray, size: int) -> np.ndarray:
    """(bands, h, w) of bytes to (bands, size, size), rounded back to bytes."""

    def weights(n: int) -> np.ndarray:
        scale = n / size
        centre = (np.arange(size) + 0.5) * scale - 0.5
        reach = np.maximum(scale, 1.0)
        m = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] - centre[:, None]) / reach)
        return m / m.sum(1, keepdims=True)

    out = weights(x.shape[1]) @ x.astype(np.float64) @ weights(x.shape[2]).T
    return np.clip(np.rint(out), 0, 255)


def _tiff_udf():
    @F.pandas_udf(PATCH_TYPE)
    def decode(content: pd.Series) -> pd.DataFrame:
        images = [parse_tiff(c) for c in content]
        return pd.DataFrame({"h": [i.shape[1] for i in images], "w": [i.shape[2] for i in images], "bands": [[b.ravel() for b in i] for i in images]})

    return decode


_TIFF_SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 16: "Q"}


def parse_tiff(data: bytes) -> np.ndarray:
    """(bands, h, w) of a baseline TIFF in strips, uncompressed or deflated, any sample width."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind not in _TIFF_SIZES or kind == 2:
            continue
        form = order + str(n) + _TIFF_SIZES[kind]
        size = struct.calcsize(form)
        place = 0 if size <= 4 else struct.unpack(order + "I", entry[8:])[0]
        raw = entry[8 : 8 + size] if size <= 4 else data[place : place + size]
        tags[tag] = struct.unpack(form, raw)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, bands, packing, planar = one(256, 0), one(257, 0), one(277, 1), one(259, 1), one(284, 1)
    if packing not in (1, 8, 32946) or 324 in tags or one(317, 1) != 1:
        raise ValueError("only strips without predictor, stored or deflated, are read")
    kind = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
    strips = [data[a : a + n] for a, n in zip(tags[273], tags[279], strict=True)]
    raw = b"".join(strips if packing == 1 else map(zlib.decompress, strips))
    x = np.frombuffer(raw, np.dtype(f"{order}{kind}{one(258, 8) // 8}"))[: bands * h * w]
    x = x.reshape(bands, h, w) if planar == 2 else x.reshape(h, w, bands).transpose(2, 0, 1)
    return x.astype(np.float64)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files, to check what was received."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
