"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the smallest of its inner s-mers (by hash) is its
first or its last one. Whether a k-mer is chosen depends on nothing but itself, so equal passages
have the same anchors wherever they stand, an edit moves only the anchors of the k-mers it
touches, and anchors of a text put together from known pieces are those of the pieces and of the
seams. ``anchors`` gives places and hashes for positional matching (``matched_offsets``); the
fingerprint of a document keeps the ``SKETCH`` smallest distinct hashes, and likeness estimates
the Jaccard similarity of two anchor sets from their fingerprints.

Results for odd input: null counts as the empty text, whose fingerprint is the empty string (two
empty fingerprints are alike, 1.0; an empty and another are not, 0.0); a text without an anchor
has one anchor, the hash of all of it; rows that repeat an id follow one another by their text's
hash; rows with a null id come last; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, S = 14, 7
SKETCH = 64
DIGITS = 10  #: hexadecimal digits kept of a hash
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = np.zeros(0, np.uint64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for texts of up to n code points."""
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places (code points) and hashes of the closed syncmers of a text."""
    c = code_points(text)
    n = len(c)
    if n < k:
        return np.zeros(0, np.int64), _NONE
    up, down = _powers(1 << max(12, (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((c.astype(np.uint64) + np.uint64(1)) * down[:n], out=total[1:])
    small = _mix((total[s:] - total[:-s]) * up[: n - s + 1])
    low, width, span = small, 1, k - s + 1
    while width < span:  # minima over windows of doubling width
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    last = len(small) - span + 1
    place = np.flatnonzero((low == small[:last]) | (low == small[span - 1 :]))
    return place, _mix((total[place + k] - total[place]) * up[place] ^ np.uint64(k))


def _sketch(hashes: np.ndarray, text: str) -> np.ndarray:
    if not len(hashes):
        if not text:
            return _NONE
        hashes = np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)
    h = hashes >> np.uint64(64 - 4 * DIGITS)
    take = SKETCH
    while True:  # the smallest distinct hashes; repeats only widen the part that is looked at
        part = h if take >= len(h) else np.partition(h, take)[:take]
        found = np.unique(part)
        if len(found) >= SKETCH or take >= len(h):
            return found[:SKETCH]
        take *= 4


def fingerprint_string(sketch: np.ndarray) -> str:
    return "".join(f"{int(x):0{DIGITS}x}" for x in sketch)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the anchor sets behind two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    smallest = np.union1d(a, b)[:SKETCH]
    return float(np.isin(both, smallest, assume_unique=True).sum() / len(smallest))


def fingerprint(text: str | None) -> str:
    return fingerprint_string(_sketch(anchors(text or "")[1], text or ""))


def matched_offsets(a: str, b: str) -> dict[int, int]:
    """How many anchors of two texts meet at each offset (place in a minus place in b)."""
    pa_, ha = anchors(a)
    pb, hb = anchors(b)
    h, first = np.unique(hb, return_index=True)
    at = np.searchsorted(h, ha)
    hit = (at < len(h)) & (h[np.minimum(at, max(0, len(h) - 1))] == ha) if len(h) else np.zeros(len(ha), bool)
    off, n = np.unique(pa_[hit] - pb[first[at[hit]]], return_counts=True)
    return dict(zip(off.tolist(), n.tolist(), strict=True))


class Edited:
    """A text whose last ``len // 2`` code points are replaced by the next text's first ones."""

    def __init__(self, a: str, at: tuple[np.ndarray, np.ndarray], b: str, bt: tuple[np.ndarray, np.ndarray]):
        m = len(a) // 2
        keep, head = len(a) - m, min(m, len(b))
        self.text = a[:keep] + b[:head]
        seam = a[max(0, keep - K + 1) : keep] + b[: min(K - 1, head)]
        # context-free: anchors inside either piece are those found in the whole texts
        self.hashes = np.concatenate([at[1][at[0] + K <= keep], anchors(seam)[1], bt[1][bt[0] + K <= head]])


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, text`` dealt so that each row is followed by the next by descending id.

    Ids are cut into even ranges (bounds from a quantile sketch; as many as there are shuffle
    partitions). The first row of each range is also sent, marked as borrowed, to the end of the
    range before it, so no row needs another task. One shuffle moves each text once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(lowest)).cast("long"))
    probabilities = [i / n for i in range(1, n)]
    bounds = keyed.select(F.col("key").cast("double").alias("key")).approxQuantile("key", probabilities, 0.2 / n) if probabilities else []
    bounds = sorted(set(bounds))
    if bounds:  # a binary search in the sorted bounds, whatever their number
        ranges = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="place", outputCol="bucket")
        keyed = ranges.transform(keyed.withColumn("place", F.col("key").cast("double"))).withColumn("bucket", F.col("bucket").cast("int"))
    else:
        keyed = keyed.withColumn("bucket", F.lit(0))
    heads = {r["bucket"]: r["head"] for r in keyed.select("bucket", "key").groupBy("bucket").agg(F.max("key").alias("head")).collect()}  # a row a range
    order = sorted(heads, reverse=True)
    to = [(heads[b], order[i - 1]) for i, b in enumerate(order)]  # the first range's head goes round to the last
    borrowed = spark.createDataFrame(to, "head long, target int")
    dealt = (
        keyed.select("doc_id", "text", "key", "bucket")
        .join(F.broadcast(borrowed), F.col("key") == F.col("head"), "left")
        .withColumn("to", F.explode(F.filter(F.array(F.struct("bucket", F.lit(0).alias("late")), F.struct(F.col("target").alias("bucket"), F.lit(1).alias("late"))), lambda x: x["bucket"].isNotNull())))
        .select("doc_id", "text", "key", F.col("to.bucket").alias("bucket"), F.col("to.late").alias("late"))
    )
    return dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "late", F.desc("key"), F.xxhash64("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: fingerprints of the text and of its edited text, and their likeness.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_anchors``; id_col must be integral.
    """
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = _with_next(picked).select("doc_id", "text", "bucket", "late")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_anchors"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (id, bucket, late, text, anchors, sketch)
        for b in batches:
            out: list[tuple] = []
            for i, text, bucket, late in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if before and before[1] == bucket and before[2] and late:
                    continue  # rows that repeat a borrowed id
                found = anchors(text)
                now = (i, bucket, late, text, found, _sketch(found[1], text))
                if before and before[1] == bucket:
                    e = Edited(before[3], before[4], text, found)
                    sketch = _sketch(e.hashes, e.text)
                    out.append(
                        (
                            before[0], len(before[3]), hashlib.sha256(e.text.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_string(before[5]),
                            fingerprint_string(sketch), likeness(before[5], sketch), likeness(before[5], now[5]), len(before[4][0]),
                        )
                    )
                before = now
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_anchors long")
