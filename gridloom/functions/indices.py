"""Per-pixel derived channels, written once for Spark columns and for NumPy arrays.

Each entry names the spectral roles it needs and an expression over them. ``Ops`` supplies the
two functions (largest, smallest) that columns and arrays spell differently.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import functions as F

EPS = 1e-6  # fixed value: added to every ratio's denominator


class Ops(NamedTuple):
    largest: Callable[..., Any]
    smallest: Callable[..., Any]


COLUMNS = Ops(F.greatest, F.least)
ARRAYS = Ops(lambda *v: np.maximum.reduce(v), lambda *v: np.minimum.reduce(v))


class Derived(NamedTuple):
    roles: tuple[str, ...]
    value: Callable[[Ops, dict[str, Any]], Any]


def contrast(plus: Any, minus: Any) -> Any:
    """Normalised difference of two non-negative quantities."""
    return (plus - minus) / (plus + minus + EPS)


def _pair(a: str, b: str) -> Derived:
    return Derived((a, b), lambda _, r: contrast(r[a], r[b]))


RGB = ("red", "green", "blue")


def _saturation(ops: Ops, r: dict[str, Any]) -> Any:
    top = ops.largest(*(r[c] for c in RGB))
    return (top - ops.smallest(*(r[c] for c in RGB))) / (top + EPS)


def _lightness(ops: Ops, r: dict[str, Any]) -> Any:
    return (ops.largest(*(r[c] for c in RGB)) + ops.smallest(*(r[c] for c in RGB))) / 2


DERIVED: dict[str, Derived] = {
    "ndvi": _pair("nir", "red"),
    "ndwi": _pair("green", "nir"),
    "ndbi": _pair("swir1", "nir"),
    "ndmi": _pair("nir", "swir1"),
    "nbr": _pair("nir", "swir2"),
    "bsi": Derived(("swir1", "red", "nir", "blue"), lambda _, r: contrast(r["swir1"] + r["red"], r["nir"] + r["blue"])),
    "exg": Derived(RGB, lambda _, r: (2 * r["green"] - r["red"] - r["blue"]) / (r["red"] + r["green"] + r["blue"] + EPS)),
    "ngrdi": _pair("green", "red"),
    "ngbdi": _pair("green", "blue"),
    "nrbdi": _pair("red", "blue"),
    "saturation": Derived(RGB, _saturation),
    "lightness": Derived(RGB, _lightness),
}


def register(name: str, roles: tuple[str, ...], value: Callable[[Ops, dict[str, Any]], Any]) -> None:
    """Add a derived channel of one's own; it can then be named in features like any other."""
    if name in DERIVED or name == "pan":
        raise ValueError(f"channel {name!r} exists")
    DERIVED[name] = Derived(tuple(roles), value)
