"""Feature vectors of patches: one narrow Arrow pass, no shuffle.

A patch row is ``(patch_id, h, w, bands)`` with ``bands`` an array of row-major arrays in the
plan's band order; every other column is carried along. Output is the row without its pixels and
with ``features``, an array of doubles in the plan's order (positions are the key, since names
may repeat). Patches are stacked by size within an Arrow batch, so kernels run over many at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.indices import ARRAYS, DERIVED
from ..plans.features import CORRELATION, FeaturePlan

#: Cells worked on at once: bounds a worker's memory whatever the batch size.
CELLS_AT_ONCE = 1 << 22


def features_of(plan: FeaturePlan, images: np.ndarray) -> np.ndarray:
    """(n, features) of a stack (n, bands, h, w)."""
    images = np.asarray(images, np.float64)
    if images.ndim != 4 or images.shape[1] != len(plan.bands):
        raise ValueError(f"patches must have {len(plan.bands)} bands")
    plan.check_size(*images.shape[2:])
    if not np.isfinite(images).all():
        raise ValueError("patches hold values that are not finite")
    n = len(images)
    if not n:
        return np.zeros((0, len(plan.features)))
    made: dict[tuple, np.ndarray] = {}
    level = images
    for scale in range(plan.max_scale + 1):
        if scale:
            level = kernels.pool(level)
        channels = _channels(plan, level, plan.channels_at(scale))
        memo: dict = {}
        for (family, s), (targets, measures) in plan.groups.items():
            if s != scale:
                continue
            if family == CORRELATION:
                for a, b in targets:
                    made["corr", scale, a, b] = kernels.correlation(channels[a], channels[b])
                continue
            found = kernels.KERNELS[family](kernels.View({c: channels[c] for c in targets}, memo), measures)
            for m in measures:
                values = found[m].reshape(n, len(targets))
                made |= {(m, scale, c, None): values[:, k] for k, c in enumerate(targets)}
    out = np.stack([made[tuple(f)] for f in plan.features], axis=1) if plan.features else np.zeros((n, 0))
    if not np.isfinite(out).all():
        raise ValueError("features are not finite")
    return out


def _channels(plan: FeaturePlan, level: np.ndarray, wanted: list[str]) -> dict[str, np.ndarray]:
    bands = {b: level[:, k] for k, b in enumerate(plan.bands)}
    out = {}
    for c in wanted:
        if c in bands:
            out[c] = bands[c]
        elif c == "pan":
            out[c] = level.mean(axis=1)
        else:
            spec = DERIVED[c]
            out[c] = spec.value(ARRAYS, {r: bands[plan.roles[r]] for r in spec.roles})
    return out


def extract(patches: DataFrame, plans: FeaturePlan | Mapping[str, FeaturePlan], zero_bands: tuple[str, ...] = ()) -> DataFrame:
    """``patches`` without pixels and with a vector column for each plan (``features`` for a single one).

    Several plans share one scan. Bands named in ``zero_bands`` are set to zero before anything
    else, also before ``pan``.
    """
    named = {"features": plans} if isinstance(plans, FeaturePlan) else dict(plans)
    bands = next(iter(named.values())).bands
    if any(p.bands != bands for p in named.values()):
        raise ValueError("plans of one pass must share their bands")
    unknown = set(zero_bands) - set(bands)
    if unknown:
        raise ValueError(f"unknown bands {sorted(unknown)}")
    off = [bands.index(b) for b in zero_bands]
    kept = [f for f in patches.schema.fields if f.name != "bands"]
    schema = T.StructType([*kept, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in named)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in ("h", "w", "bands")}
            hs, ws = (batch.column(at[c]).to_numpy(zero_copy_only=False) for c in ("h", "w"))
            vectors = {c: [None] * len(batch) for c in named}
            column = batch.column(at["bands"])
            for h, w in sorted({(int(a), int(b)) for a, b in zip(hs, ws, strict=True)}):
                rows = np.flatnonzero((hs == h) & (ws == w))
                step = max(1, CELLS_AT_ONCE // (h * w * len(bands)))
                for k in range(0, len(rows), step):
                    part = rows[k : k + step]
                    images = _images(column, part, len(bands), h, w)
                    if off:
                        images[:, off] = 0
                    for c, plan in named.items():
                        for i, v in zip(part, features_of(plan, images), strict=True):
                            vectors[c][i] = v
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array(v, pa.list_(pa.float64())) for v in vectors.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return patches.mapInArrow(run, schema)


def _images(column: pa.ListArray, rows: np.ndarray, bands: int, h: int, w: int) -> np.ndarray:
    """A stack (n, bands, h, w) from the nested arrays of some rows."""
    picked = column.take(pa.array(rows))
    inner = picked.flatten()
    cells = inner.flatten()
    if picked.null_count or len(inner) != len(rows) * bands or inner.null_count or len(cells) != len(inner) * h * w or cells.null_count:
        raise ValueError(f"a patch does not hold {bands} bands of {h}x{w} values")
    return cells.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), bands, h, w)


def feature_schema(spark: SparkSession, plan: FeaturePlan) -> DataFrame:
    """``pos, name, family`` of a plan's vector."""
    return spark.createDataFrame(plan.schema_rows(), "pos int, name string, family string")
