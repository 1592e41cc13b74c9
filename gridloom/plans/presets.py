"""Named feature sets for 13-band patches and for RGB patches."""

from __future__ import annotations

from .features import FAMILIES, FeaturePlan, feature_name

# Band order, role overrides and the 33 selected features.
BANDS_13 = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B09", "B10", "B11", "B12", "B8A")
ROLES_13 = {"swir1": "B12", "swir2": "B8A"}
SELECTED_33 = (
    "lbp_uniform_ndbi", "grad_std_nbr", "corner_frac_ndvi", "grad_std_ndwi",
    "grad_mean_s2_B02", "grad_mean_B04", "grad_mean_s2_B03", "std_s1_nbr",
    "orient_entropy_B12", "orient_entropy_B01", "grad_std_bsi", "p75_B11", "p10_B12",
    "corner_mag_ndvi", "grad_mean_ndvi", "p90_B09", "grad_mean_nbr", "lbp_uniform_ndvi",
    "grad_mean_B05", "std_B05", "line_top3_ndvi", "p10_B04", "p50_B12",
    "orient_entropy_B03", "p75_B04", "blob_largest_ndvi", "corner_frac_pan",
    "grad_mean_ndbi", "p75_B01", "p10_B07", "orient_entropy_s1_B02", "mean_B03",
    "tail_aniso_low_ndvi",
)
RGB_BANDS = ("red", "green", "blue")
# The 33 features selected for RGB patches.
RGB_33 = (
    "grad_std_blue", "grad_mean_ngbdi", "p90_blue", "grad_std_nrbdi", "grad_std_lightness",
    "p50_green", "p10_blue", "grad_mean_red", "grad_std_green", "grad_std_s2_blue", "mean_red",
    "grad_mean_s2_blue", "mean_blue", "p75_red", "fft_slope_pan", "grad_mean_blue",
    "orient_entropy_blue", "spread_ngrdi", "grad_mean_s2_red", "corner_mag_saturation",
    "orient_entropy_red", "grad_mean_s1_red", "grad_mean_s1_ngbdi", "p10_green", "p50_blue",
    "corner_frac_pan", "lbp_entropy_pan", "grad_mean_s2_green", "grad_mean_saturation",
    "grad_std_s1_blue", "lbp_entropy_saturation", "grad_std_red", "grad_std_s1_green",
)
# Pairs whose correlation the candidate pool holds (twice, as it was recorded).
POOL_PAIRS = (("B04", "B08"), ("B03", "B08"), ("B02", "B08"), ("B12", "B08"), ("B04", "B12"), ("B03", "B04"), ("B08", "B8A"), ("B12", "B8A"))
POOL_INDICES = ("ndvi", "ndwi", "ndbi", "ndmi", "nbr", "bsi")
POOL_MAPS = ("pan", "ndvi", "ndbi")


def _each(channels, *measures: str, scales=(0,)) -> list[str]:
    """All measures of all channels at all scales: scale first, then measure, then channel."""
    return [feature_name(m, c, s) for s in scales for m in measures for c in channels]


def pool_377() -> tuple[str, ...]:
    """The candidate pool. Eight correlations stand in it twice, so positions are the key."""
    correlations = [f"corr_{a}_{b}" for a, b in POOL_PAIRS]
    by_band = lambda family: [feature_name(m, b) for b in BANDS_13 for m in FAMILIES[family]]
    by_map = [feature_name(m, c) for family in ("hough", "harris", "lbp", "blobs", "fft_slope") for c in POOL_MAPS for m in FAMILIES[family]]
    blocks = [
        _each(BANDS_13, "mean", "std", *FAMILIES["percentiles"][:5]),
        _each(BANDS_13, *FAMILIES["gradient"], scales=(0, 1, 2)),
        _each(BANDS_13, "coherence", scales=(0, 1)),
        _each(BANDS_13, "orient_entropy"),
        by_band("histogram"),
        by_band("fft_peak"),
        correlations,
        _each(POOL_INDICES, "std", "grad_mean", "grad_std", "spread"),
        by_map,
        _each(POOL_INDICES, "coherence"),
        _each(POOL_INDICES, "std", "grad_mean", scales=(1,)),
        correlations,
        _each(BANDS_13, "orient_entropy", scales=(1,)),
    ]
    return tuple(name for block in blocks for name in block)


def pool_389() -> tuple[str, ...]:
    """The pool and the tail measures of its maps."""
    tails = [f"tail_{stat}_{side}_{c}" for c in POOL_MAPS for side in ("low", "high") for stat in ("aniso", "spread")]
    return (*pool_377(), *tails)


def moments_52() -> tuple[str, ...]:
    return tuple(feature_name(m, b) for b in BANDS_13 for m in FAMILIES["moments"])


def rgb_moments_12() -> tuple[str, ...]:
    return tuple(feature_name(m, b) for b in RGB_BANDS for m in FAMILIES["moments"])


SETS = {"33": lambda: SELECTED_33, "52": moments_52, "377": pool_377, "389": pool_389}


def preset(name: str) -> FeaturePlan:
    """The plan of a named set over the 13 bands."""
    if name not in SETS:
        raise ValueError(f"unknown set {name!r}; sets are {', '.join(SETS)}")
    return FeaturePlan(BANDS_13, SETS[name](), ROLES_13)


def rgb_preset(name: str) -> FeaturePlan:
    """The plan of a named set over RGB bands: ``moments`` (12 features) or ``33``."""
    sets = {"moments": rgb_moments_12, "33": lambda: RGB_33}
    if name not in sets:
        raise ValueError(f"unknown set {name!r}; sets are {', '.join(sets)}")
    return FeaturePlan(RGB_BANDS, sets[name]())
