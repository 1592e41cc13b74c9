"""What reports and figures are drawn from: definitions, curves, ranks, heat maps and a summary text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .probes import family_summary

# What the index channels mean under the 13-band preset's roles.
INDEX_TEXT = {
    "ndvi": "(B08 - B04) / (B08 + B04 + epsilon)",
    "ndwi": "(B03 - B08) / (B03 + B08 + epsilon)",
    "ndbi": "legacy alias: (B12 - B08) / (B12 + B08 + epsilon)",
    "ndmi": "legacy alias: (B08 - B12) / (B08 + B12 + epsilon)",
    "nbr": "legacy alias: (B08 - B8A) / (B08 + B8A + epsilon)",
    "bsi": "legacy alias: ((B12 + B04) - (B08 + B02)) / ((B12 + B04) + (B08 + B02) + epsilon)",
}


# Fixed value: the text for the pan channel.
PAN_TEXT = "mean of all 13 TIFF channels; B10 fixed to zero in b10_zeroed variant"


def physical_definition(name: Column) -> Column:
    """Text for a feature name: of an index in it, the two channels of a correlation, pan, or the band.

    A name without a definition is an error; a null name stays null.
    """
    rules = [(name.contains(index), F.lit(text)) for index, text in INDEX_TEXT.items()]
    rules += [
        (name.startswith("corr_"), F.array_join(F.slice(F.split(name, "_"), 2, 1000), ";")),
        (name.contains("pan"), F.lit(PAN_TEXT)),
        (name.rlike("_(B0[1-9]|B1[0-2]|B8A)$"), F.element_at(F.split(name, "_"), -1)),
        (name.isNotNull(), F.raise_error(F.concat(F.lit("no definition of the feature "), name)).cast("string")),
    ]
    return F.coalesce(*[F.when(case, text) for case, text in rules])


def score_curve(rounds: DataFrame) -> DataFrame:
    """Points of the elimination curve, from many features to few."""
    return rounds.select("features", "parameters", "val_accuracy", "test_accuracy").orderBy(F.desc("features"))


def top_importances(ranked: DataFrame, schema: DataFrame, k: int = 30) -> DataFrame:
    """The k most important features with their names (joined by position)."""
    return ranked.orderBy("rank").limit(k).join(schema, "pos").select("rank", "pos", "name", "family", "l2")


def heat_map(scores: DataFrame, row: str, column: str, value: str = "r2") -> DataFrame:
    """Mean values in a grid, a cell a row; every combination of the axes is there."""
    cells = scores.groupBy(row, column).agg(F.avg(value).alias(value))
    axes = scores.select(row).distinct().join(scores.select(column).distinct(), F.lit(True))  # two short axes
    return axes.join(cells, [row, column], "left")


def interval_plot(results: DataFrame, value: str, order: str) -> DataFrame:
    """Points with their intervals, and their place on the axis."""
    return results.select("*", F.row_number().over(Window.orderBy(order)).alias("place")).select("place", order, value, f"{value}_ci_low", f"{value}_ci_high")


def accuracy_table(results: DataFrame) -> str:
    """A Markdown table of a small result."""
    columns = results.columns
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(v) for v in r) + " |" for r in results.collect()]) + "\n"


def coverage_faults(results: DataFrame, expected: DataFrame, key: list[str]) -> int:
    """How many expected keys lack a result, or results lack an expectation."""
    a, b = results.select(*key).distinct(), expected.select(*key).distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a)).count()


__all__ = ["accuracy_table", "coverage_faults", "family_summary", "heat_map", "interval_plot", "physical_definition", "score_curve", "top_importances"]
