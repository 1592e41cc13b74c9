"""Feature families as NumPy kernels over stacks of channels, for the Arrow path.

A kernel takes a ``View``, a stack ``(n, h, w)`` of patches x channels in float64, and the
measures wanted, and gives ``{measure: (n,)}``. What several families need of a channel (its
differences, direction histogram, power) is worked out once and kept in the view's memo, which
``operators.extract`` shares among the families of a scale. Definitions are those of the column
builders in ``operators.families``; tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

from .indices import EPS

ANGLES = 60
RHO_STEP = 2
HARRIS_K = 0.05
EDGE_QUANTILE = 0.85
OCTANTS = 8


class View:
    """Channels of one size, with what has been derived from each.

    ``arrays`` are ``(patches, h, w)`` by channel name; a derived stack holds, like ``x``, all
    channels of the first patch, then of the second, and so on.
    """

    def __init__(self, arrays: dict[str, np.ndarray], memo: dict | None = None):
        self.arrays, self.memo = arrays, {} if memo is None else memo

    @classmethod
    def of(cls, x: View | np.ndarray) -> View:
        return x if isinstance(x, View) else cls({"": np.asarray(x, np.float64)})

    def stack(self, make: Callable[[np.ndarray], np.ndarray], name: str) -> np.ndarray:
        """One derived array per channel, stacked; each is made once."""
        parts = []
        for c, a in self.arrays.items():
            if (name, c) not in self.memo:
                self.memo[name, c] = make(a)
            parts.append(self.memo[name, c])
        if len(parts) == 1:
            return parts[0]
        out = np.stack(parts, axis=1)
        return out.reshape(-1, *out.shape[2:])

    @property
    def x(self) -> np.ndarray:
        return self.stack(lambda a: a, "x")

    @property
    def steps(self) -> np.ndarray:
        """(n, 2, cells): differences to the right and down on the grid that has both."""
        return self.stack(_steps, "steps")

    @property
    def magnitude(self) -> np.ndarray:
        return self.stack(lambda a: np.sqrt(np.square(_steps(a)).sum(1)), "magnitude")

    @property
    def octants(self) -> np.ndarray:
        """(n, 8): gradient magnitude by direction, in steps of an eighth of a half turn."""
        return self.stack(_octants, "octants")

    @property
    def power(self) -> np.ndarray:
        return self.stack(_power, "power")


Kernel = Callable[[View | np.ndarray, list[str]], dict[str, np.ndarray]]


def _steps(a: np.ndarray) -> np.ndarray:
    origin = a[:, :-1, :-1]
    return np.stack([(a[:, :-1, 1:] - origin).reshape(len(a), -1), (a[:, 1:, :-1] - origin).reshape(len(a), -1)], axis=1)


def _octants(a: np.ndarray) -> np.ndarray:
    gx, gy = _steps(a).transpose(1, 0, 2)
    # an unsigned direction: turned into the upper half plane (and to the right on its edge)
    down = (gy < 0) | ((gy == 0) & (gx < 0))
    gx, gy = np.where(down, -gx, gx), np.where(down, -gy, gy)
    t = np.tan(np.pi / OCTANTS)
    rise = np.abs(gx)
    # eighths of the right quarter are counted up, those of the left one come after the upright
    right = gx > 0
    turn = np.where(right, (gy >= t * rise).astype(np.int64) + (gy >= rise) + (t * gy >= rise), 4 + (rise > 0) * ((t * gy <= rise).astype(np.int64) + (gy <= rise) + (gy <= t * rise)))
    at = turn + OCTANTS * np.arange(len(a))[:, None]
    return np.bincount(at.ravel(), np.sqrt(gx * gx + gy * gy).ravel(), OCTANTS * len(a)).reshape(-1, OCTANTS)


def pool(x: np.ndarray) -> np.ndarray:
    """Mean of 2x2 cells; an odd last row or column is left out."""
    h, w = x.shape[-2] // 2 * 2, x.shape[-1] // 2 * 2
    return (x[..., 0:h:2, 0:w:2] + x[..., 0:h:2, 1:w:2] + x[..., 1:h:2, 0:w:2] + x[..., 1:h:2, 1:w:2]) / 4


def flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1)


def moments(x, wanted):
    f = flat(View.of(x).x)
    made = {"mean": f.mean, "std": f.std, "min": f.min, "max": f.max}
    return {m: made[m](axis=1) for m in wanted}


def percentiles(x, wanted):
    ranks = sorted({int(m[1:]) for m in wanted if m != "spread"} | ({10, 90} if "spread" in wanted else set()))
    q = dict(zip(ranks, np.percentile(flat(View.of(x).x), ranks, axis=1), strict=True))
    return {m: q[90] - q[10] if m == "spread" else q[int(m[1:])] for m in wanted}


def gradient(x, wanted):
    g = View.of(x).magnitude
    return {"grad_mean": g.mean(1), "grad_std": g.std(1)}


def coherence(x, wanted):
    g = View.of(x).steps
    both = np.einsum("nik,njk->nij", g, g) / g.shape[2]
    return {"coherence": _anisotropy(both[:, 0, 0], both[:, 1, 1], both[:, 0, 1])}


def _anisotropy(xx, yy, xy):
    return np.sqrt((xx - yy) ** 2 + 4 * xy * xy) / (xx + yy + EPS)


def orientation_shares(x: View | np.ndarray, bins: int) -> np.ndarray:
    """Shares of gradient magnitude by direction, in 8 bins or in 4 of two octants each."""
    held = View.of(x).octants
    held = held.reshape(len(held), bins, -1).sum(2)
    return held / (held.sum(1, keepdims=True) + EPS)


def entropy(x, wanted):
    p = orientation_shares(x, 8)
    return {"orient_entropy": -(p * np.log(p + EPS)).sum(1)}


def histogram(x, wanted):
    p = orientation_shares(x, 4)
    return {m: p[:, int(m[-1])] for m in wanted}


@cache
def _radius(h: int, w: int) -> np.ndarray:
    n = min(h, w)
    return np.hypot(np.fft.fftfreq(h)[:, None] * n, np.fft.fftfreq(w)[None, :] * n)


def _power(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.fft2(x - x.mean((1, 2), keepdims=True))) ** 2


def fft_peak(x, wanted):
    view = View.of(x)
    h, w = view.x.shape[1:]
    n, r = min(h, w), _radius(h, w)
    ring = view.power[:, (r >= n / 16) & (r <= 3 * n / 8)]
    return {"fft_peak": np.log1p(ring.max(1) / (ring.mean(1) + EPS))}


def fft_slope(x, wanted):
    view = View.of(x)
    n, h, w = view.x.shape
    top = min(h, w) // 2
    ring = np.rint(_radius(h, w)).astype(np.int64).ravel()
    inside = (ring >= 1) & (ring <= top)
    spot = (ring[inside] - 1) + top * np.arange(n)[:, None]
    total = np.bincount(spot.ravel(), flat(view.power)[:, inside].ravel(), top * n).reshape(-1, top)
    y = np.log(total / np.bincount(ring[inside] - 1, minlength=top) + EPS)
    t = np.log(np.arange(1, top + 1))
    t = t - t.mean()
    return {"fft_slope": (y - y.mean(1, keepdims=True)) @ t / (t @ t)}


@cache
def _rho_bins(h: int, w: int) -> tuple[np.ndarray, int, float]:
    diagonal = float(np.hypot(h, w))
    n = int(np.ceil(diagonal)) + 1
    y, x = (c.ravel() for c in np.mgrid[:h, :w].astype(np.float64))
    angle = np.arange(ANGLES) * (np.pi / ANGLES)
    rho = np.cos(angle)[:, None] * x + np.sin(angle)[:, None] * y
    return np.clip(np.floor((rho + diagonal) / RHO_STEP).astype(np.int64), 0, n - 1), n, diagonal


def hough(x, wanted):
    view = View.of(x)
    h, w = view.x.shape[1:]
    bins, n, diagonal = _rho_bins(h - 1, w - 1)
    m = view.magnitude
    edge = m > np.percentile(m, 100 * EDGE_QUANTILE, axis=1)[:, None]
    row, pixel = np.nonzero(edge)
    best = np.empty((len(m), ANGLES))
    for k in range(ANGLES):
        votes = np.bincount(row * n + bins[k, pixel], minlength=len(m) * n).reshape(len(m), n)
        best[:, k] = votes.max(1)
    edges = edge.sum(1) + EPS
    best.sort(axis=1)
    return {"line_peak_frac": best[:, -1] / edges, "line_peak_len": best[:, -1] / diagonal, "line_top3": best[:, -3:].sum(1) / edges}


def _box(v: np.ndarray) -> np.ndarray:
    p = np.pad(v, ((0, 0), (1, 1), (1, 1)), mode="edge")
    rows = p[:, :, :-2] + p[:, :, 1:-1] + p[:, :, 2:]
    return (rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]) / 9


def harris(x, wanted):
    x = View.of(x).x
    gy, gx = np.gradient(x, axis=(1, 2))  # central inside, one-sided at the edges
    xx, yy, xy = _box(gx * gx), _box(gy * gy), _box(gx * gy)
    trace = xx + yy
    response = flat(xx * yy - xy * xy - HARRIS_K * trace * trace)
    trace = flat(trace)
    active = trace > np.median(trace, axis=1)[:, None]
    return {
        "corner_frac": ((response > 0) & active).sum(1) / (active.sum(1) + EPS),
        "corner_mag": np.sqrt(np.maximum(response, 0)).sum(1) / (trace.sum(1) + EPS),
    }


#: The eight neighbours (dy, dx) in circular order.
CIRCLE = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def lbp(x, wanted):
    x = View.of(x).x
    h, w = x.shape[1:]
    inner = x[:, 1:-1, 1:-1]
    bits = [(x[:, 1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] > inner).astype(np.int8) for dy, dx in CIRCLE]
    ones = sum(b.astype(np.int64) for b in bits)
    turns = sum((a != b).astype(np.int64) for a, b in zip(bits, bits[1:] + bits[:1], strict=True))
    code = flat(np.where(turns <= 2, ones, 9))
    share = np.bincount((code + 10 * np.arange(len(x))[:, None]).ravel(), minlength=10 * len(x)).reshape(-1, 10) / code.shape[1]
    p = np.maximum(share, 1e-12)
    return {"lbp_entropy": -(p * np.log(p)).sum(1), "lbp_uniform": share[:, :9].sum(1)}


def region_sizes(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(image, cells) of every eight-connected region of masks (n, h, w).

    Rows are cut into runs of set cells, and runs that touch in neighbouring rows are united by
    the smallest label with pointer jumping, so the work is that of the runs, not of the cells.
    """
    n, h, w = mask.shape
    begins = mask.copy()
    begins[:, :, 1:] &= ~mask[:, :, :-1]
    run = (np.cumsum(begins.ravel()) - 1).reshape(mask.shape)
    image = np.flatnonzero(begins.ravel()) // (h * w)
    length = np.bincount(run[mask], minlength=len(image))
    top, low = mask[:, :-1], mask[:, 1:]
    a, b = run[:, :-1], run[:, 1:]
    under = top & low
    first = under.copy()
    first[:, :, 1:] &= ~under[:, :, :-1]  # one link for each stretch in which two runs touch
    # corners count only where no cell beside them makes the link already
    right = top[:, :, :-1] & low[:, :, 1:] & ~top[:, :, 1:] & ~low[:, :, :-1]
    left = top[:, :, 1:] & low[:, :, :-1] & ~top[:, :, :-1] & ~low[:, :, 1:]
    i = np.concatenate([a[first], a[:, :, :-1][right], a[:, :, 1:][left]])
    j = np.concatenate([b[first], b[:, :, 1:][right], b[:, :, :-1][left]])
    label = np.arange(len(image))
    while len(i):
        p, q = label[i], label[j]
        open_ = p != q
        if not open_.any():
            break
        i, j, p, q = i[open_], j[open_], p[open_], q[open_]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    size = np.bincount(label, length, minlength=len(image)).astype(np.int64)
    root = size > 0
    return image[root], size[root]


def blobs(x, wanted):
    x = View.of(x).x
    n, cells = len(x), x.shape[1] * x.shape[2]
    image, size = region_sizes(x > np.median(flat(x), axis=1)[:, None, None])
    count = np.bincount(image, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, image, size)
    total = np.bincount(image, size, minlength=n)
    return {"blob_largest": top / cells, "blob_count": np.log1p(count), "blob_mean": total / np.maximum(count, 1) / cells}


def tail(x, wanted):
    x = View.of(x).x
    _, h, w = x.shape
    f = flat(x)
    low, high = np.percentile(f, [25, 75], axis=1)
    ys, xs = (c.ravel() for c in np.meshgrid(np.linspace(-1, 1, h), np.linspace(-1, 1, w), indexing="ij"))
    out = {}
    for side, weight in (("low", np.maximum(low[:, None] - f, 0)), ("high", np.maximum(f - high[:, None], 0))):
        mass = weight.sum(1) + EPS
        dx = xs - (weight @ xs / mass)[:, None]
        dy = ys - (weight @ ys / mass)[:, None]
        xx, yy, xy = ((weight * a * b).sum(1) / mass for a, b in ((dx, dx), (dy, dy), (dx, dy)))
        out[f"tail_aniso_{side}"] = _anisotropy(xx, yy, xy)
        out[f"tail_spread_{side}"] = np.sqrt(xx + yy)
    return out


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Population covariance over the product of deviations, each raised by EPS."""
    a, b = flat(a), flat(b)
    cov = ((a - a.mean(1, keepdims=True)) * (b - b.mean(1, keepdims=True))).mean(1)
    return cov / ((a.std(1) + EPS) * (b.std(1) + EPS))


KERNELS: dict[str, Kernel] = {
    "moments": moments, "percentiles": percentiles, "gradient": gradient, "coherence": coherence, "entropy": entropy, "histogram": histogram,
    "fft_peak": fft_peak, "hough": hough, "harris": harris, "lbp": lbp, "blobs": blobs, "fft_slope": fft_slope, "tail": tail,
}
