"""Feature families as relational plans over ``patch_id, channel, pos, v``.

Neighbours are reached by ``lag`` and ``lead`` over one window ``(patch_id, channel) order by
pos`` with offsets 1 and w, so a family needs a single exchange: the window's partitioning also
serves the final aggregation. Families that are not relational (spectra, regions) are the Arrow
kernels grouped by channel. Each function gives ``patch_id, channel, <measures>``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.indices import EPS
from ..functions.kernels import ANGLES, CIRCLE, EDGE_QUANTILE, HARRIS_K, RHO_STEP
from ..plans.features import CORRELATION, FAMILIES, FeaturePlan
from . import pixels as P

KEY = ["patch_id", "channel"]


def _line() -> WindowSpec:
    """All pixels of a channel in order; the one window that every neighbour is reached by."""
    return Window.partitionBy(*KEY).orderBy("pos")


def _all() -> WindowSpec:
    return Window.partitionBy(*KEY)


def _y(w: int) -> Column:
    return F.floor(F.col("pos") / w)


def _x(w: int) -> Column:
    return F.col("pos") % w



def moments(px: DataFrame, h: int, w: int) -> DataFrame:
    return px.groupBy(*KEY).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def percentiles(px: DataFrame, h: int, w: int) -> DataFrame:
    ranks = (10, 25, 50, 75, 90)
    q = px.groupBy(*KEY).agg(F.percentile("v", [r / 100 for r in ranks]).alias("q"))
    return q.select(*KEY, *[F.col("q")[k].alias(f"p{r}") for k, r in enumerate(ranks)], (F.col("q")[4] - F.col("q")[0]).alias("spread"))


def differences(px: DataFrame, h: int, w: int) -> DataFrame:
    """``gx, gy`` forward differences on the grid of (h-1) x (w-1)."""
    right, down = F.lead("v", 1).over(_line()), F.lead("v", w).over(_line())
    out = px.select(*KEY, "pos", (right - F.col("v")).alias("gx"), (down - F.col("v")).alias("gy"))
    return out.where((_y(w) < h - 1) & (_x(w) < w - 1))


_MAGNITUDE = "sqrt(gx * gx + gy * gy)"


def gradient(px: DataFrame, h: int, w: int) -> DataFrame:
    m = F.expr(_MAGNITUDE)
    return differences(px, h, w).groupBy(*KEY).agg(F.avg(m).alias("grad_mean"), F.stddev_pop(m).alias("grad_std"))


def _anisotropy(xx: Column, yy: Column, xy: Column) -> Column:
    return F.sqrt((xx - yy) * (xx - yy) + F.lit(4.0) * xy * xy) / (xx + yy + F.lit(EPS))


def coherence(px: DataFrame, h: int, w: int) -> DataFrame:
    m = differences(px, h, w).groupBy(*KEY).agg(F.avg(F.expr("gx * gx")).alias("xx"), F.avg(F.expr("gy * gy")).alias("yy"), F.avg(F.expr("gx * gy")).alias("xy"))
    return m.select(*KEY, _anisotropy(F.col("xx"), F.col("yy"), F.col("xy")).alias("coherence"))


def orientation_shares(px: DataFrame, h: int, w: int, bins: int) -> DataFrame:
    """``s0, s1, ..``: shares of gradient magnitude by direction, as conditional sums in one pass."""
    turn = F.pmod(F.atan2("gy", "gx"), F.lit(math.pi))
    cell = F.least(F.floor(turn / F.lit(math.pi / bins)), F.lit(bins - 1))
    g = differences(px, h, w).select(*KEY, cell.alias("cell"), F.expr(_MAGNITUDE).alias("m"))
    sums = g.groupBy(*KEY).agg(*[F.sum(F.when(F.col("cell") == b, F.col("m")).otherwise(0.0)).alias(f"m{b}") for b in range(bins)])
    total = sum((F.col(f"m{b}") for b in range(1, bins)), F.col("m0")) + F.lit(EPS)
    return sums.select(*KEY, *[(F.col(f"m{b}") / total).alias(f"s{b}") for b in range(bins)])


def entropy(px: DataFrame, h: int, w: int) -> DataFrame:
    s = orientation_shares(px, h, w, 8)
    terms = [F.col(f"s{b}") * F.log(F.col(f"s{b}") + F.lit(EPS)) for b in range(8)]
    return s.select(*KEY, (-sum(terms[1:], terms[0])).alias("orient_entropy"))


def histogram(px: DataFrame, h: int, w: int) -> DataFrame:
    s = orientation_shares(px, h, w, 4)
    return s.select(*KEY, *[F.col(f"s{b}").alias(f"orient_hist{b}") for b in range(4)])


def hough(px: DataFrame, h: int, w: int) -> DataFrame:
    gh, gw = h - 1, w - 1
    diagonal = math.hypot(gh, gw)
    last = math.ceil(diagonal)
    m = differences(px, h, w).select(*KEY, "pos", F.expr(_MAGNITUDE).alias("m"))
    m = m.withColumn("edge", F.col("m") > F.percentile("m", EDGE_QUANTILE).over(_all()))
    # 60 angles an edge pixel, one empty row any other: all steps keep the window's partitioning,
    # and a flat channel, which has no edge, still has its row
    angles = F.when(F.col("edge"), F.sequence(F.lit(0), F.lit(ANGLES - 1)))
    votes = m.select(*KEY, _x(w).cast("double").alias("x"), _y(w).cast("double").alias("y"), F.explode_outer(angles).alias("k"))
    angle = F.col("k") * F.lit(math.pi / ANGLES)
    rho = F.cos(angle) * F.col("x") + F.sin(angle) * F.col("y")
    cell = F.when(F.col("k").isNotNull(), F.least(F.greatest(F.floor((rho + F.lit(diagonal)) / F.lit(float(RHO_STEP))), F.lit(0)), F.lit(last)))
    counted = votes.groupBy(*KEY, "k", cell.alias("cell")).agg(F.count("*").alias("n"))
    by_angle = counted.groupBy(*KEY, "k").agg(F.max("n").alias("peak"), F.sum("n").alias("edges"))
    real = lambda c: F.when(F.col("k").isNotNull(), F.col(c).cast("double"))
    best = by_angle.groupBy(*KEY).agg(F.coalesce(F.max(real("edges")), F.lit(0.0)).alias("edges"), F.slice(F.sort_array(F.collect_list(real("peak")), asc=False), 1, 3).alias("top"))
    peak = F.coalesce(F.get("top", F.lit(0)), F.lit(0.0))
    three = F.aggregate("top", F.lit(0.0), lambda a, n: a + n)
    n = F.col("edges") + F.lit(EPS)
    return best.select(*KEY, (peak / n).alias("line_peak_frac"), (peak / F.lit(diagonal)).alias("line_peak_len"), (three / n).alias("line_top3"))


def harris(px: DataFrame, h: int, w: int) -> DataFrame:
    def slope(offset: int, place: Column, size: int) -> Column:
        before, after = F.lag("v", offset).over(_line()), F.lead("v", offset).over(_line())
        return F.when(place == 0, after - F.col("v")).when(place == size - 1, F.col("v") - before).otherwise((after - before) / F.lit(2.0))

    g = px.select(*KEY, "pos", slope(1, _x(w), w).alias("gx"), slope(w, _y(w), h).alias("gy"))
    g = g.select(*KEY, "pos", *[F.expr(e).alias(n) for n, e in (("xx", "gx * gx"), ("yy", "gy * gy"), ("xy", "gx * gy"))])

    def three(c: str, offset: int, place: Column, size: int) -> Column:
        before = F.when(place == 0, F.col(c)).otherwise(F.lag(c, offset).over(_line()))
        after = F.when(place == size - 1, F.col(c)).otherwise(F.lead(c, offset).over(_line()))
        return before + F.col(c) + after

    products = ("xx", "yy", "xy")
    g = g.select(*KEY, "pos", *[three(c, 1, _x(w), w).alias(c) for c in products])
    g = g.select(*KEY, *[(three(c, w, _y(w), h) / F.lit(9.0)).alias(c) for c in products])
    g = g.select(*KEY, F.expr("xx * yy - xy * xy").alias("det"), F.expr("xx + yy").alias("trace"))
    g = g.select(*KEY, "trace", (F.col("det") - F.lit(HARRIS_K) * F.col("trace") * F.col("trace")).alias("r"))
    g = g.withColumn("cut", F.percentile("trace", 0.5).over(_all()))
    active = F.col("trace") > F.col("cut")
    return g.groupBy(*KEY).agg(
        (F.count_if(active & (F.col("r") > 0)).cast("double") / (F.count_if(active).cast("double") + F.lit(EPS))).alias("corner_frac"),
        (F.sum(F.sqrt(F.greatest("r", F.lit(0.0)))) / (F.sum("trace") + F.lit(EPS))).alias("corner_mag"),
    )


def lbp(px: DataFrame, h: int, w: int) -> DataFrame:
    def bit(dy: int, dx: int) -> Column:
        k = dy * w + dx
        other = F.lead("v", k).over(_line()) if k > 0 else F.lag("v", -k).over(_line())
        return (other > F.col("v")).cast("int")

    names = [f"b{k}" for k in range(len(CIRCLE))]
    bits = px.select(*KEY, "pos", *[bit(dy, dx).alias(n) for n, (dy, dx) in zip(names, CIRCLE, strict=True)])
    inner = bits.where(_y(w).between(1, h - 2) & _x(w).between(1, w - 2))
    ones = F.expr(" + ".join(names))
    turns = F.expr(" + ".join(f"cast({a} <> {b} as int)" for a, b in zip(names, names[1:] + names[:1], strict=True)))
    coded = inner.select(*KEY, F.when(turns <= 2, ones).otherwise(9).alias("code"))
    n = F.lit(float((h - 2) * (w - 2)))
    shares = coded.groupBy(*KEY).agg(*[(F.count_if(F.col("code") == c).cast("double") / n).alias(f"h{c}") for c in range(10)])
    p = [F.greatest(F.col(f"h{c}"), F.lit(1e-12)) for c in range(10)]
    terms = [x * F.log(x) for x in p]
    uniform = sum((F.col(f"h{c}") for c in range(1, 9)), F.col("h0"))
    return shares.select(*KEY, (-sum(terms[1:], terms[0])).alias("lbp_entropy"), uniform.alias("lbp_uniform"))


def tail(px: DataFrame, h: int, w: int) -> DataFrame:
    x = F.lit(-1.0) + _x(w).cast("double") * F.lit(2.0 / (w - 1))
    y = F.lit(-1.0) + _y(w).cast("double") * F.lit(2.0 / (h - 1))
    q = px.select(*KEY, "v", x.alias("x"), y.alias("y"), F.percentile("v", [0.25, 0.75]).over(_all()).alias("q"))
    weights = q.select(*KEY, "x", "y", F.greatest(F.col("q")[0] - F.col("v"), F.lit(0.0)).alias("low"), F.greatest(F.col("v") - F.col("q")[1], F.lit(0.0)).alias("high"))
    moments_ = {"m": "1.0D", "x": "x", "y": "y", "xx": "x * x", "yy": "y * y", "xy": "x * y"}
    sums = weights.groupBy(*KEY).agg(*[F.sum(F.expr(f"{side} * ({e})")).alias(f"{side}_{n}") for side in ("low", "high") for n, e in moments_.items()])
    out = []
    for side in ("low", "high"):
        s = {n: F.col(f"{side}_{n}") for n in moments_}
        mass = s["m"] + F.lit(EPS)
        mx, my = s["x"] / mass, s["y"] / mass
        xx = (s["xx"] - F.lit(2.0) * mx * s["x"] + mx * mx * s["m"]) / mass
        yy = (s["yy"] - F.lit(2.0) * my * s["y"] + my * my * s["m"]) / mass
        xy = (s["xy"] - mx * s["y"] - my * s["x"] + mx * my * s["m"]) / mass
        out += [_anisotropy(xx, yy, xy).alias(f"tail_aniso_{side}"), F.sqrt(F.greatest(xx + yy, F.lit(0.0))).alias(f"tail_spread_{side}")]
    return sums.select(*KEY, *out)


def _kernel_family(family: str) -> Callable[[DataFrame, int, int], DataFrame]:
    """A family that is no relational plan: channels are gathered and handed to the Arrow kernel."""
    measures = list(FAMILIES[family])

    def build(px: DataFrame, h: int, w: int) -> DataFrame:
        # a channel of a patch is a small bounded group: h * w values
        stacked = px.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("vs"))
        schema = stacked.select(*KEY).schema

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.stack(b["vs"].to_numpy()).reshape(-1, h, w) if len(b) else np.zeros((0, h, w))
                found = kernels.KERNELS[family](x, measures) if len(b) else {m: [] for m in measures}
                yield b[KEY].assign(**found)

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        return stacked.mapInPandas(run, kinds + "".join(f", {m} double" for m in measures))

    return build


BUILDERS: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {
    "moments": moments, "percentiles": percentiles, "gradient": gradient, "coherence": coherence, "entropy": entropy, "histogram": histogram,
    "hough": hough, "harris": harris, "lbp": lbp, "tail": tail,
    **{f: _kernel_family(f) for f in ("blobs", "fft_peak", "fft_slope")},
}


def correlations(px: DataFrame, plan: FeaturePlan, pairs: list[tuple[str, str]]) -> DataFrame:
    """``patch_id, corr_a_b, ..``: population covariance over deviations each raised by EPS."""
    wide = px.select("patch_id", *[P.channel(plan, c).alias(c) for c in dict.fromkeys(c for p in pairs for c in p)])

    def one(a: str, b: str) -> Column:
        return F.covar_pop(a, b) / ((F.stddev_pop(a) + F.lit(EPS)) * (F.stddev_pop(b) + F.lit(EPS)))

    return wide.groupBy("patch_id").agg(*[one(a, b).alias(f"corr_{a}_{b}") for a, b in pairs])


def family(patches: DataFrame, plan: FeaturePlan, name: str, channels: list[str], h: int, w: int, scale: int = 0) -> DataFrame:
    """``patch_id, channel, <measures>`` of one family at one scale, from a patch table."""
    px = P.pooled(P.pixels(patches, plan.bands), plan.bands, h, w, scale)
    return BUILDERS[name](P.long(px, plan, channels), h >> scale, w >> scale)


def features_long(patches: DataFrame, plan: FeaturePlan, h: int, w: int) -> DataFrame:
    """``patch_id, pos, value`` of a whole plan by relational plans only (the pixel relation shuffles)."""
    plan.check_size(h, w)
    positions: dict[tuple, list[int]] = {}
    for k, f in enumerate(plan.features):
        positions.setdefault(tuple(f), []).append(k)
    parts = []
    for (name, scale), (targets, measures) in plan.groups.items():
        px = P.pooled(P.pixels(patches, plan.bands), plan.bands, h, w, scale)
        if name == CORRELATION:
            wide = correlations(px, plan, targets)
            values = [(F.col(f"corr_{a}_{b}"), positions["corr", scale, a, b]) for a, b in targets]
            rows = [F.struct(F.lit(k).alias("pos"), v.alias("value")) for v, ks in values for k in ks]
            parts.append(wide.select("patch_id", F.explode(F.array(*rows)).alias("r")))
            continue
        found = BUILDERS[name](P.long(px, plan, targets), h >> scale, w >> scale)
        wanted = [(m, c, k) for m in measures for c in targets for k in positions.get((m, scale, c, None), [])]
        pick = F.array(*[F.when(F.col("channel") == c, F.struct(F.lit(k).alias("pos"), F.col(m).alias("value"))) for m, c, k in wanted])
        parts.append(found.select("patch_id", F.explode(F.array_compact(pick)).alias("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("patch_id", "r.pos", "r.value")
