"""Kernels on images whose features are known, and against plain definitions."""

import math

import numpy as np
import pytest

from gridloom.functions import kernels as k
from gridloom.operators.extract import features_of
from gridloom.plans.features import FAMILIES, FeaturePlan


def one(family, image):
    found = k.KERNELS[family](np.asarray(image, float)[None], list(FAMILIES[family]))
    return {m: float(v[0]) for m, v in found.items()}


RAMP = np.tile(np.arange(16.0), (16, 1))
RNG = np.random.default_rng(0)
NOISE = RNG.normal(size=(20, 17))


def test_constant():
    flat = np.full((16, 16), 3.0)
    assert one("moments", flat) == {"mean": 3, "std": 0, "min": 3, "max": 3}
    assert one("gradient", flat) == {"grad_mean": 0, "grad_std": 0}
    assert one("lbp", flat)["lbp_uniform"] == 1 and abs(one("lbp", flat)["lbp_entropy"]) < 1e-9
    assert one("blobs", flat) == {"blob_largest": 0, "blob_count": 0, "blob_mean": 0}
    assert one("hough", flat) == {"line_peak_frac": 0, "line_peak_len": 0, "line_top3": 0}
    assert one("harris", flat) == {"corner_frac": 0, "corner_mag": 0}
    assert all(abs(v) < 1e-3 for v in one("tail", flat).values())


def test_ramp():
    assert one("gradient", RAMP)["grad_mean"] == 1
    assert one("coherence", RAMP)["coherence"] == pytest.approx(1, abs=1e-5)
    assert one("histogram", RAMP)["orient_hist0"] == pytest.approx(1, abs=1e-5)
    assert one("histogram", RAMP.T)["orient_hist2"] == pytest.approx(1, abs=1e-5)
    assert one("percentiles", RAMP)["spread"] == pytest.approx(np.percentile(RAMP, 90) - np.percentile(RAMP, 10))


def test_wave_has_a_peak():
    wave = np.sin(2 * np.pi * 3 * np.arange(32) / 32)[None, :] + np.zeros((32, 1))
    ring = k._radius(32, 32)
    n = ((ring >= 2) & (ring <= 12)).sum()
    assert one("fft_peak", wave)["fft_peak"] == pytest.approx(math.log1p(n / 2), rel=1e-6)


def test_regions_touch_at_corners():
    m = np.zeros((2, 16, 16), bool)
    m[0, 0:2, 0:2] = m[0, 2, 2] = m[0, 10:13, 10:13] = True
    image, size = k.region_sizes(m)
    assert image.tolist() == [0, 0] and sorted(size) == [5, 9]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.45, 0.6, 0.9, 1.0])
def test_regions_against_flood_fill(share):
    m = RNG.random((20, 16, 19)) < share
    image, size = k.region_sizes(m)
    for n, a in enumerate(m):
        seen, found = np.zeros(a.shape, bool), []
        for y, x in np.argwhere(a):
            todo, cells = [(y, x)], 0
            while todo:
                p, q = todo.pop()
                if 0 <= p < 16 and 0 <= q < 19 and a[p, q] and not seen[p, q]:
                    seen[p, q] = True
                    cells += 1
                    todo += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            found += [cells] * (cells > 0)
        assert sorted(size[image == n]) == sorted(found)


def test_directions_by_angle():
    g = RNG.integers(-3, 4, size=(500, 2)).astype(float)
    x = np.zeros((500, 2, 2))
    x[:, 0, 1], x[:, 1, 0] = g[:, 0], g[:, 1]
    angle = np.mod(np.arctan2(g[:, 1], g[:, 0]), np.pi)
    want = np.minimum(np.floor(angle / (np.pi / 8)), 7).astype(int)
    held = k._octants(x)
    moving = np.hypot(*g.T) > 0
    assert (held.argmax(1)[moving] == want[moving]).all()
    assert np.allclose(held.sum(1), np.hypot(*g.T))


def test_line_votes():
    image = np.zeros((17, 17))
    image[8:] = 10.0  # one horizontal edge
    f = one("hough", image)
    assert f["line_peak_frac"] == pytest.approx(1, abs=1e-4)
    assert f["line_peak_len"] == pytest.approx(16 / math.hypot(16, 16), abs=1e-6)


def test_lbp_definition():
    h, w = NOISE.shape
    codes = []
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            bits = [NOISE[y + dy, x + dx] > NOISE[y, x] for dy, dx in k.CIRCLE]
            turns = sum(bits[i] != bits[i - 1] for i in range(8))
            codes.append(sum(bits) if turns <= 2 else 9)
    p = np.bincount(codes, minlength=10) / len(codes)
    assert one("lbp", NOISE)["lbp_uniform"] == pytest.approx(p[:9].sum())
    assert one("lbp", NOISE)["lbp_entropy"] == pytest.approx(-sum(v * math.log(v) for v in p if v > 0))


def test_spectrum_of_oblong_images():
    h, w = 16, 32
    x = RNG.normal(size=(h, w))
    ys, xs = np.mgrid[:h, :w]
    v = x - x.mean()
    power = np.array([[abs((v * np.exp(-2j * np.pi * (a * ys / h + b * xs / w))).sum()) ** 2 for b in range(w)] for a in range(h)])
    assert np.allclose(k.View.of(x[None]).power[0], power)
    assert k._radius(h, w)[0, 1] == pytest.approx(0.5) and k._radius(h, w)[1, 0] == pytest.approx(1)


def test_pooling_leaves_odd_edges_out():
    assert k.pool(np.arange(17 * 19.0).reshape(1, 17, 19)).shape == (1, 8, 9)
    assert k.pool(np.arange(16.0).reshape(1, 4, 4))[0].tolist() == [[2.5, 4.5], [10.5, 12.5]]


@pytest.mark.parametrize("family", ["gradient", "lbp", "hough", "blobs", "harris"])
def test_an_added_constant_changes_nothing(family):
    image = np.round(NOISE * 1000)
    assert one(family, image) == pytest.approx(one(family, image + 500), abs=1e-9)


def test_channels_are_pooled_before_they_are_derived():
    x = RNG.integers(1, 1000, size=(2, 2, 16, 16)).astype(float)
    plan = FeaturePlan(["red", "nir"], ["mean_s1_ndvi", "mean_s1_pan"])
    red, nir = k.pool(x[:, 0]), k.pool(x[:, 1])
    want = np.stack([((nir - red) / (nir + red + 1e-6)).mean((1, 2)), ((nir + red) / 2).mean((1, 2))], 1)
    assert np.allclose(features_of(plan, x), want)


def test_bad_patches():
    plan = FeaturePlan(["red"], ["mean_red"])
    assert features_of(plan, np.zeros((0, 1, 16, 16))).shape == (0, 1)
    for bad in (np.zeros((1, 2, 16, 16)), np.zeros((1, 1, 8, 16)), np.full((1, 1, 16, 16), np.nan)):
        with pytest.raises(ValueError):
            features_of(plan, bad)
