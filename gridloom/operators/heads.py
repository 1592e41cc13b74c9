"""Affine classification heads: standardising, fitting, sweeping, scoring and pruning features.

Rows have a vector column and an integer label. A head is ``W (classes x features)`` and ``b`` in
raw units. Fitting is Spark's multinomial logistic regression on standardised vectors (training
mean, population deviation, 1 where it is zero) with penalty ``1 / (C n)``, i.e. the objective
mean cross-entropy + |W|^2 / (2 C n); predictions are a narrow pass with the head broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import stratified_subset
from .alignment import position_stats, subset

# Fixed values of the study: penalties and grids.
HEAD_C, MOMENTS_C, RGB_C = 3.0, 300.0, 30.0
ELIMINATION_GRID = (0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
MOMENTS_GRID = (
    0.0001, 0.0003, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 150.0, 200.0, 250.0, 300.0, 400.0, 500.0,
    700.0, 1000.0, 2000.0,
)
RGB_GRID = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0)
TRAIN_PERCENTS = (1, 2, 5, 10, 20, 50, 100)
MAX_ITER = 4000


class NotConverged(RuntimeError):
    """The solver used up its iterations."""


@dataclass
class Head:
    weights: np.ndarray
    bias: np.ndarray
    iterations: int = 0
    standardized: np.ndarray | None = field(default=None, repr=False)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.T + self.bias

    def shifted(self, reference: int) -> Head:
        """The same decisions with one class at zero."""
        return Head(self.weights - self.weights[reference], self.bias - self.bias[reference], self.iterations)

    def stored_parameters(self) -> int:
        """Values to keep: all weights and the bias of each class that is not all zero."""
        used = (self.weights != 0).any(axis=1) | (self.bias != 0)
        return int(used.sum()) * (self.weights.shape[1] + 1)


def scaler(train: DataFrame, vector: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation by position (1 where it is zero)."""
    rows = sorted(position_stats(train, vector).collect(), key=lambda r: r["pos"])  # a row a position
    mean = np.array([r["mean"] for r in rows])
    std = np.array([0.0 if r["lo"] == r["hi"] else r["std"] for r in rows])
    return mean, np.where(std == 0, 1.0, std)


def standardized(df: DataFrame, mean: np.ndarray, std: np.ndarray, vector: str = "features") -> DataFrame:
    """``df`` with standardised vectors; the constants are as wide as one vector."""
    m, s = (F.array(*[F.lit(float(v)) for v in a]) for a in (mean, std))
    centred = F.zip_with(vector, m, lambda v, c: v - c)
    return df.withColumn(vector, F.zip_with(centred, s, lambda v, d: v / d))


def prepared(df: DataFrame, mean: np.ndarray, std: np.ndarray, vector: str, label: str) -> DataFrame:
    """What the solver reads: ``label`` and a dense ``x``."""
    rows = standardized(df.select(F.col(label).cast("double").alias("label"), F.col(vector).alias("x")), mean, std, "x")
    return rows.select("label", array_to_vector("x").alias("x"))


def fit_prepared(rows: DataFrame, n: int, c: float, max_iter: int = MAX_ITER, tol: float = 1e-9) -> Head:
    """A head on standardised inputs (``standardized`` weights only)."""
    solver = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    model = solver.fit(rows)
    if model.summary.totalIterations >= max_iter:
        raise NotConverged(f"C={c:g}: {max_iter} iterations used up")
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return Head(w, b, model.summary.totalIterations, w)


def fold(head: Head, mean: np.ndarray, std: np.ndarray) -> Head:
    """A head on standardised inputs as one on raw inputs."""
    w = head.weights / std
    return Head(w, head.bias - w @ mean, head.iterations, head.weights)


def fit(train: DataFrame, c: float, vector: str = "features", label: str = "label", max_iter: int = MAX_ITER) -> Head:
    """A head in raw units."""
    mean, std = scaler(train, vector)
    rows = prepared(train, mean, std, vector, label).persist()
    try:
        return fold(fit_prepared(rows, rows.count(), c, max_iter), mean, std)
    finally:
        rows.unpersist()


# --- prediction -------------------------------------------------------------------------------


def predict(df: DataFrame, head: Head, vector: str = "features", out: str = "prediction", probabilities: str | None = None) -> DataFrame:
    """``df`` with the class of the highest score (the lowest of equal ones), and probabilities if named."""
    shared = df.sparkSession.sparkContext.broadcast((head.weights, head.bias))
    extra = [T.StructField(out, T.IntegerType())] + ([T.StructField(probabilities, T.ArrayType(T.DoubleType()))] if probabilities else [])
    schema = T.StructType([*df.schema.fields, *extra])
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            z = x @ w.T + b if len(batch) else np.zeros((0, len(b)))
            made = [pa.array(z.argmax(1).astype(np.int32) if len(batch) else [], pa.int32())]
            if probabilities:
                made.append(pa.array(list(softmax(z)), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return e / e.sum(axis=1, keepdims=True) if len(z) else z


def scores(vector: Column, head: DataFrame | Head) -> Column:
    """Scores of all classes as an expression, for heads of a few thousand values."""
    rows = [F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in w]), lambda x, y: x * y), F.lit(float(b)), lambda a, v: a + v) for w, b in zip(head.weights, head.bias, strict=True)]
    return F.array(*rows)


def argmax(z: Column) -> Column:
    """Place of the largest element, the first of equal ones."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def softmax_column(z: Column) -> Column:
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


# --- scores -----------------------------------------------------------------------------------

LOSS_FLOOR = 2.220446049250313e-16  # fixed value: the smallest probability that counts


def accuracy(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``n, correct, accuracy`` in one row."""
    right = F.col(label) == F.col(prediction)
    return predicted.agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.avg(right.cast("double")).alias("accuracy"))


def accuracy_by_class(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predicted.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col(prediction)).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("n"))


def log_loss(probability_of_truth: Column) -> Column:
    return -F.log(F.greatest(probability_of_truth, F.lit(LOSS_FLOOR)))


def classification_metrics(predicted: DataFrame, label: str = "label", probabilities: str = "probabilities") -> DataFrame:
    """``accuracy, correct, errors, log_loss`` of probability vectors."""
    right = argmax(F.col(probabilities)) == F.col(label)
    return predicted.agg(
        F.avg(right.cast("double")).alias("accuracy"),
        F.count_if(right).alias("correct"),
        F.count_if(~right).alias("errors"),
        F.avg(log_loss(F.get(F.col(probabilities), F.col(label)))).alias("log_loss"),
    )


# --- selection --------------------------------------------------------------------------------


def pick_c(swept: DataFrame) -> DataFrame:
    """``swept`` (``c, accuracy``) with ``selected``: best accuracy, the smallest C of equal ones."""
    best = F.row_number().over(Window.orderBy(F.desc("accuracy"), F.asc("c")))  # one row a C
    return swept.withColumn("selected", best == 1)


def sweep(train: DataFrame, val: DataFrame, grid: Iterable[float], vector: str = "features", label: str = "label", max_iter: int = MAX_ITER) -> tuple[Head, list[dict]]:
    """The head with the best validation accuracy (smallest C of equal ones), and one row per C."""
    mean, std = scaler(train, vector)
    rows = prepared(train, mean, std, vector, label).persist()
    try:
        n, best, records = rows.count(), None, []
        for c in sorted(grid):
            head = fold(fit_prepared(rows, n, c, max_iter), mean, std)
            found = accuracy(predict(val.select(vector, label), head, vector), label).first()
            records.append({"c": float(c), "accuracy": found["accuracy"], "correct": found["correct"], "n": found["n"], "iterations": head.iterations})
            if best is None or found["accuracy"] > best[0]:
                best = (found["accuracy"], head, len(records) - 1)
        for k, r in enumerate(records):
            r["selected"] = k == best[2]
        return best[1], records
    finally:
        rows.unpersist()


def importance(head: Head) -> list[dict]:
    """Features by the norm of their standardised weights over classes; ties by position."""
    w = head.standardized if head.standardized is not None else head.weights
    norm, mean, top = np.sqrt((w * w).sum(0)), np.abs(w).mean(0), np.abs(w).max(0)
    order = np.lexsort((np.arange(len(norm)), -norm))
    return [{"rank": k + 1, "pos": int(p), "l2": float(norm[p]), "mean_abs": float(mean[p]), "max_abs": float(top[p])} for k, p in enumerate(order)]


def importance_rank(weights: DataFrame) -> DataFrame:
    """The same ranking over a table ``class, pos, w`` (one window over one row per feature)."""
    n = weights.groupBy("pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l2"), F.avg(F.abs("w")).alias("mean_abs"), F.max(F.abs("w")).alias("max_abs"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("l2"), F.asc("pos"))))


def eliminate(
    train: DataFrame, val: DataFrame, test: DataFrame | None = None, step: int = 5, minimum: int = 4, grid: Iterable[float] = ELIMINATION_GRID,
    vector: str = "features", label: str = "label", max_iter: int = MAX_ITER,
) -> tuple[list[dict], list[int]]:
    """Recursive elimination: sweep, record, drop the ``step`` least important, until ``minimum``.

    Returns one row per round and the positions in the order of their removal. The vectors of
    each split are persisted once; a round reads a subset of positions.
    """
    width = train.select(F.max(F.size(vector)).alias("n")).first()["n"]
    if step < 1 or minimum < 1 or minimum > width or (width - minimum) % step:
        raise ValueError(f"{width} features cannot be cut to {minimum} by steps of {step}")
    splits = [d.select(vector, label).persist() if d is not None else None for d in (train, val, test)]
    try:
        active, removed, rounds = list(range(width)), [], []
        while True:
            now = [d.withColumn(vector, subset(F.col(vector), active)) if d is not None else None for d in splits]
            head, records = sweep(now[0], now[1], grid, vector, label, max_iter)
            chosen = next(r for r in records if r["selected"])
            row = {"features": len(active), "parameters": head.stored_parameters(), "c": chosen["c"], "val_accuracy": chosen["accuracy"], "iterations": chosen["iterations"], "positions": list(active)}
            row["train_accuracy"] = accuracy(predict(now[0], head, vector), label).first()["accuracy"]
            if now[2] is not None:
                row["test_accuracy"] = accuracy(predict(now[2], head, vector), label).first()["accuracy"]
            rounds.append(row)
            if len(active) <= minimum:
                return rounds, removed
            w = head.standardized
            norm = np.sqrt((w * w).sum(0))
            # least important first; of equal ones the smaller position goes first
            gone = [active[k] for k in np.lexsort((np.arange(len(active)), norm))[:step]]
            removed += gone
            active = [p for p in active if p not in set(gone)]
    finally:
        for d in splits:
            if d is not None:
                d.unpersist()


def evaluate_set(train: DataFrame, val: DataFrame, test: DataFrame, positions: list[int], grid: Iterable[float] = ELIMINATION_GRID, vector: str = "features", label: str = "label") -> dict:
    """Sweep and scores of a fixed set of positions."""
    now = [d.select(subset(F.col(vector), positions).alias(vector), label) for d in (train, val, test)]
    head, records = sweep(now[0], now[1], grid, vector, label)
    chosen = next(r for r in records if r["selected"])
    return {"features": len(positions), "parameters": head.stored_parameters(), "c": chosen["c"], "val_accuracy": chosen["accuracy"], "test_accuracy": accuracy(predict(now[2], head, vector), label).first()["accuracy"]}


def learning_curve(
    train: DataFrame, test: DataFrame, c: float, key: str, percents: Iterable[int] = TRAIN_PERCENTS, seeds: Iterable[int] = range(5), vector: str = "features", label: str = "label"
) -> list[dict]:
    """Test accuracy by share of training rows (stratified, seeded): mean and sample deviation."""
    out = []
    for p in percents:
        runs = []
        for seed in [0] if p >= 100 else seeds:
            part = train if p >= 100 else stratified_subset(train.select(key, label, vector), label, key, p / 100, seed)
            head = fit(part, c, vector, label)
            runs.append(accuracy(predict(test.select(vector, label), head, vector), label).first()["accuracy"])
        out.append({"percent": p, "runs": len(runs), "mean": float(np.mean(runs)), "std": float(np.std(runs, ddof=1)) if len(runs) > 1 else 0.0})
    return out
