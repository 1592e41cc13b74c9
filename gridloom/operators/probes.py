"""Probes on two blocks of features, and paired tests between fixed heads."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import multiplicities, positions
from .alignment import position_stats
from .heads import Head, NotConverged, argmax, classification_metrics, fit_prepared, log_loss, predict

# Fixed values of the study.
PROBE_CS = tuple(float(c) for c in np.logspace(-4, 8, 13))
BETAS = (0.0, 0.25, 1.0, 4.0)
BUDGET = 8000
LINEAR_PROBE_CS = tuple(float(c) for c in np.logspace(-6, 4, 40))


@dataclass
class Block:
    """How one block of columns enters a probe: centred, scaled, constants left out."""

    mean: np.ndarray
    multiplier: np.ndarray
    active: np.ndarray
    scale: float

    def column(self, vector: Column, beta: float = 1.0) -> Column:
        pick = [int(k) for k in np.flatnonzero(self.active)]
        terms = [(F.get(vector, F.lit(k)) - F.lit(float(self.mean[k]))) * F.lit(float(self.multiplier[k] * beta)) for k in pick]
        return F.array(*terms) if terms else F.array().cast("array<double>")


def block(train: DataFrame, vector: str, standardize: bool) -> Block:
    """Z-scores over the root of their number, or centred columns over the norm of their deviations."""
    rows = sorted(position_stats(train, vector).collect(), key=lambda r: r["pos"])
    active = np.array([r["lo"] != r["hi"] for r in rows], bool)
    mean = np.array([r["mean"] if r["lo"] != r["hi"] else r["lo"] for r in rows], float)
    std = np.array([r["std"] for r in rows], float)
    if not active.any():
        return Block(mean, np.zeros(len(rows)), active, 0.0)
    scale = float(np.sqrt(active.sum()) if standardize else np.linalg.norm(std[active]))
    with np.errstate(divide="ignore"):
        multiplier = np.where(active, (1 / np.where(active, std, 1) if standardize else 1.0) / scale, 0.0)
    if not np.isfinite(multiplier).all():
        raise ValueError("a column's deviation is out of range")
    return Block(mean, multiplier, active, scale)


@dataclass
class Probe:
    """A head over the concatenated raw columns of both blocks."""

    head: Head
    c: float
    beta: float
    primary_dim: int


def select_probe(
    train: DataFrame, val: DataFrame, primary: str, extra: str | None = None, cs: Iterable[float] = PROBE_CS, betas: Iterable[float] = BETAS,
    standardize_primary: bool = False, label: str = "label", budget: int = BUDGET,
) -> tuple[Probe, list[dict]]:
    """The probe with the best validation accuracy; then the smaller loss, the smaller C, the earlier beta.

    Beta scales the extra block; at zero the block is left out altogether, so that is the plain
    baseline, and it is tried first. A fit that uses up its budget is repeated once with twice the
    budget and then is an error.
    """
    order = list(dict.fromkeys(float(b) for b in betas)) if extra else [0.0]
    order = [0.0] * (0.0 in order) + [b for b in order if b]
    blocks = block(train, primary, standardize_primary), block(train, extra, True) if extra else None
    n = train.count()
    both = F.concat(F.col(primary), F.col(extra)) if extra else F.col(primary)
    scored = val.select(both.cast("array<double>").alias("x"), label)
    width = len(blocks[0].mean)
    best, records = None, []
    for at, beta in enumerate(order):
        use = bool(beta) and blocks[1] is not None and blocks[1].active.any()
        parts = [blocks[0].column(F.col(primary))] + ([blocks[1].column(F.col(extra), beta)] if use else [])
        rows = train.select(F.col(label).cast("double").alias("label"), array_to_vector(F.concat(*parts)).alias("x")).persist()
        try:
            for c in sorted(float(c) for c in cs):
                try:
                    raw, retried = fit_prepared(rows, n, c, budget), False
                except NotConverged:
                    raw, retried = fit_prepared(rows, n, c, 2 * budget), True
                head = _unscaled(raw, blocks, beta if use else 0.0, width)
                m = classification_metrics(predict(scored, head, "x", probabilities="probabilities"), label).first()
                records.append({"c": c, "beta": beta, "val_accuracy": m["accuracy"], "val_log_loss": m["log_loss"], "iterations": raw.iterations, "retried": retried, "baseline": beta == 0, "selected": False})
                key = (-m["accuracy"], m["log_loss"], c, at)
                if best is None or key < best[0]:
                    best = (key, Probe(head, c, beta, width), len(records) - 1)
        finally:
            rows.unpersist()
    records[best[2]]["selected"] = True
    return best[1], records


def _unscaled(raw: Head, blocks: tuple[Block, Block | None], beta: float, width: int) -> Head:
    extra = blocks[1]
    w = np.zeros((len(raw.bias), width + (len(extra.mean) if extra else 0)))
    a = int(blocks[0].active.sum())
    w[:, np.flatnonzero(blocks[0].active)] = raw.weights[:, :a] * blocks[0].multiplier[blocks[0].active]
    if extra and beta:
        w[:, width + np.flatnonzero(extra.active)] = raw.weights[:, a:] * extra.multiplier[extra.active] * beta
    mean = np.concatenate([blocks[0].mean, extra.mean]) if extra else blocks[0].mean
    return Head(w, raw.bias - w @ mean, raw.iterations)


# --- paired tests -----------------------------------------------------------------------------


def mcnemar_pvalue(gained: Column, lost: Column) -> Column:
    """Exact two-sided binomial test of the discordant pairs; 1 without any."""
    n = (gained + lost).cast("int")
    low = F.least(gained, lost).cast("int")
    half = n.cast("double") * F.log(F.lit(2.0))
    first = F.struct(F.lit(0.0).alias("term"), F.exp(-half).alias("sum"))  # k = 0: log C(n, 0) = 0

    def add(s: Column, k: Column) -> Column:
        term = s["term"] + F.log((n - k + 1).cast("double")) - F.log(k.cast("double"))
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term - half)).alias("sum"))

    upto = F.when(low >= 1, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(upto, first, add, lambda s: s["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * tail))


def paired_counts(df: DataFrame, baseline: Column, combined: Column, by: list[str] | None = None) -> DataFrame:
    """Counts of right and wrong answers of two heads on the same rows, by groups if given."""
    b, c = baseline, combined
    aggregates = [
        F.count("*").alias("n"),
        F.count_if(~b & c).alias("gained_correct"),
        F.count_if(b & ~c).alias("lost_correct"),
        F.count_if(b & c).alias("both_correct"),
        F.count_if(~b & ~c).alias("both_wrong"),
    ]
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def paired_tests(counts: DataFrame) -> DataFrame:
    """``counts`` with accuracy difference, relative error reduction and McNemar's p-value."""
    gained, lost = F.col("gained_correct"), F.col("lost_correct")
    errors = gained + F.col("both_wrong")
    return counts.withColumns(
        {
            "accuracy_delta": (gained - lost) / F.col("n"),
            "relative_error_reduction": F.when(errors > 0, (gained - lost) / errors),
            "mcnemar_pvalue": mcnemar_pvalue(gained, lost),
        }
    )


def paired_bootstrap(df: DataFrame, key: str, values: list[str], draws: int = 200, seed: int = 0) -> DataFrame:
    """95 % intervals of the means of per-row differences over row resamples: ``<v>_ci_low, _ci_high``."""
    n = df.count()
    ranked = positions(df.select(key, *values), [key], name="rank").withColumn("row", F.col("rank") - 1)
    means = multiplicities(df, "row", n, draws, seed).join(ranked, "row").groupBy("draw").agg(*[(F.sum(F.col("n") * F.col(v)) / F.lit(float(n))).alias(v) for v in values])
    q = {v: F.percentile(v, [0.025, 0.975]) for v in values}
    return means.agg(*[x for v in values for x in (q[v][0].alias(f"{v}_ci_low"), q[v][1].alias(f"{v}_ci_high"))])


def accuracy_interval(predicted: DataFrame, key: str, label: str = "label", prediction: str = "prediction", draws: int = 200, seed: int = 0) -> DataFrame:
    """``accuracy`` of one head and its 95 % interval over row resamples."""
    right = predicted.select(key, (F.col(label) == F.col(prediction)).cast("double").alias("accuracy"))
    whole = right.agg(F.avg("accuracy").alias("accuracy")).withColumn("_one", F.lit(1))
    return whole.join(paired_bootstrap(right, key, ["accuracy"], draws, seed).withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


def outcomes(df: DataFrame, label: str, probabilities: str, tag: str) -> DataFrame:
    """``df`` with whether a head is right on each row and its loss: ``<tag>_right, <tag>_loss``."""
    return df.withColumns({f"{tag}_right": argmax(F.col(probabilities)) == F.col(label), f"{tag}_loss": log_loss(F.get(F.col(probabilities), F.col(label)))})


def paired_metrics(df: DataFrame, key: str, label: str, baseline: str, combined: str, draws: int = 200, seed: int = 0) -> dict:
    """All paired figures of two heads' probabilities on the same rows."""
    rows = outcomes(outcomes(df, label, baseline, "b"), label, combined, "c")
    rows = rows.select(key, "b_right", "c_right", (F.col("c_right").cast("double") - F.col("b_right").cast("double")).alias("accuracy"), (F.col("b_loss") - F.col("c_loss")).alias("log_loss"))
    tests = paired_tests(paired_counts(rows, F.col("b_right"), F.col("c_right"))).first().asDict()
    gain = rows.agg(F.avg("log_loss").alias("log_loss_improvement")).first().asDict()
    return tests | gain | paired_bootstrap(rows, key, ["accuracy", "log_loss"], draws, seed).first().asDict()


def holm(df: DataFrame, p: str = "p", order: str = "id", out: str = "p_holm") -> DataFrame:
    """``df`` with Holm's adjusted p-values; equal ones keep their order. One family of tests: few rows."""
    by = Window.orderBy(F.col(p).asc(), F.col(order).asc())
    m = F.count("*").over(Window.partitionBy())
    stepped = df.withColumn("_s", F.col(p) * (m - F.row_number().over(by) + 1).cast("double"))
    return stepped.withColumn(out, F.least(F.lit(1.0), F.max("_s").over(by.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def family_summary(scores: DataFrame, by: list[str], value: str = "r2") -> DataFrame:
    """Count, mean, median and quartiles of defined values by groups."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    return scores.groupBy(*by).agg(F.count("*").alias("features"), F.count(value).alias("defined"), F.avg(value).alias("mean"), q[1].alias("median"), q[0].alias("q25"), q[2].alias("q75"))
