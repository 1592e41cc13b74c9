"""Patches as a pixel relation, and channels as columns of it.

A pixel row is ``patch_id, pos, <bands>`` with ``pos = y * w + x``: all bands of a place stand in
one row, so derived channels are plain expressions and need no join. ``long`` turns the channels
that a family needs into rows ``patch_id, channel, pos, v``. Patches are of one size, which the
caller names, since window offsets are part of the plan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import COLUMNS, DERIVED
from ..plans.features import FeaturePlan


def pixels(patches: DataFrame, bands: Iterable[str]) -> DataFrame:
    """``patch_id, pos, <bands>``: one generator over the zipped band arrays."""
    bands = list(bands)
    zipped = F.arrays_zip(*[F.col("bands")[k].alias(f"b{k}") for k in range(len(bands))])
    spread = patches.select("patch_id", F.posexplode(zipped).alias("pos", "p"))
    return spread.select("patch_id", "pos", *[F.col("p")[f"b{k}"].alias(b) for k, b in enumerate(bands)])


def zero_bands(px: DataFrame, bands: Iterable[str]) -> DataFrame:
    """Bands set to zero, before anything is derived from them."""
    return px.withColumns({b: F.lit(0.0) for b in bands})


def pooled(px: DataFrame, bands: Iterable[str], h: int, w: int, times: int = 1) -> DataFrame:
    """Means of 2x2 cells, ``times`` over; odd last rows and columns are left out each time."""
    for _ in range(times):
        y, x = F.floor(F.col("pos") / w).cast("int"), F.col("pos") % w
        cell = (F.floor(y / 2) * (w // 2) + F.floor(x / 2)).cast("int")
        px = (
            px.where((y < h // 2 * 2) & (x < w // 2 * 2))
            .groupBy("patch_id", cell.alias("pos"))
            .agg(*[F.avg(b).alias(b) for b in bands])
        )
        h, w = h // 2, w // 2
    return px


def channel(plan: FeaturePlan, name: str) -> Column:
    """The expression of a channel over the bands of a pixel row."""
    if name in plan.bands:
        return F.col(name)
    if name == "pan":
        return sum((F.col(b) for b in plan.bands[1:]), F.col(plan.bands[0])) / F.lit(float(len(plan.bands)))
    spec = DERIVED[name]
    return spec.value(COLUMNS, {r: F.col(plan.roles[r]) for r in spec.roles})


def long(px: DataFrame, plan: FeaturePlan, channels: Iterable[str]) -> DataFrame:
    """``patch_id, channel, pos, v`` for the channels named."""
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), channel(plan, c).cast("double").alias("v")) for c in channels])
    return px.select("patch_id", "pos", F.explode(rows).alias("c")).select("patch_id", "c.channel", "pos", "c.v")
