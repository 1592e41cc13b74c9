"""Whole studies put together from the operators: final head, elimination, and representation overlap."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.draws import shuffled_partner
from .operators import alignment as A
from .operators import decoding as L
from .operators import heads as H
from .operators import probes as Q
from .operators.extract import extract
from .plans.features import FeaturePlan
from .plans.study import DRAWS, MODELS, NULL_SEEDS, REPRESENTATIONS, Study, expected_jobs
from .sources.tables import union_rows

SPLITS = ("train", "val", "test")


def split_of(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def two_variants(patches: DataFrame, plans: Mapping[str, FeaturePlan], zeroed: str = "B10") -> DataFrame:
    """Vectors of every plan for the patches as they are and with one band at zero, by ``variant``."""
    return union_rows([extract(patches, plans, off).withColumn("variant", F.lit(name)) for name, off in (("original", ()), ("b10_zeroed", (zeroed,)))])


def final_model(features: DataFrame, vector: str, c: float = H.HEAD_C, reference: int = 0) -> tuple[H.Head, DataFrame]:
    """The head at a fixed penalty, with one class at zero, and its accuracy on val and test."""
    head = H.fit(split_of(features, "train"), c, vector).shifted(reference)
    scored = H.predict(features.where("split <> 'train'"), head, vector)
    table = scored.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("correct"))
    return head, table.withColumns({"accuracy": F.col("correct") / F.col("n"), "parameters": F.lit(head.stored_parameters())})


def baseline_sweep(features: DataFrame, vector: str, grid: Iterable[float] = H.MOMENTS_GRID) -> tuple[H.Head, list[dict], float]:
    """The swept head of a baseline set, its grid, and its test accuracy."""
    head, records = H.sweep(split_of(features, "train"), split_of(features, "val"), grid, vector)
    return head, records, H.accuracy(H.predict(split_of(features, "test"), head, vector)).first()["accuracy"]


def learning_curves(features: DataFrame, key: str, sets: Mapping[str, float], protocols: Mapping[str, DataFrame], **options) -> list[dict]:
    """Curves of several sets (name -> penalty) under several splits (name -> ``key, split``)."""
    out = []
    for vector, c in sets.items():
        for protocol, split in protocols.items():
            rows = features.drop("split").join(split, key)
            for r in H.learning_curve(split_of(rows, "train"), split_of(rows, "test"), c, key, vector=vector, **options):
                out.append({"features": vector, "C": c, "split_protocol": protocol, **r})
    return out


def importance_study(features: DataFrame, vector: str, schema: DataFrame, grid: Iterable[float] = H.ELIMINATION_GRID, step: int = 5, minimum: int = 4) -> dict[str, Any]:
    """Importances of the full set and the elimination curve, with the order in which features went."""
    parts = [split_of(features, s) for s in SPLITS]
    head, records = H.sweep(parts[0], parts[1], grid, vector)
    rounds, removed = H.eliminate(*parts, step=step, minimum=minimum, grid=grid, vector=vector)
    names = {r["pos"]: r["name"] for r in schema.collect()}
    importances = [{**r, "name": names[r["pos"]]} for r in H.importance(head)]
    return {"sweep": records, "importances": importances, "rounds": rounds, "removed": [names[p] for p in removed]}


class OverlapStudy:
    """How much of learned representations the fixed features explain, and what they add.

    ``handcrafted`` has ``key, label, split, variant`` and a vector column per representation;
    ``backbones`` maps a model to ``key, label, split, features``. Jobs are selected on train and
    val, locked, and only then scored on test (see ``plans.study``). Tables are joined by key after
    their keys and labels have been checked against each other.
    """

    def __init__(
        self, spark: SparkSession, folder: str, handcrafted: DataFrame, backbones: Mapping[str, DataFrame], pilot: bool = False,
        alphas: Iterable[float] = L.ALPHAS, cs: Iterable[float] = Q.PROBE_CS, betas: Iterable[float] = Q.BETAS, draws: int = DRAWS,
    ):
        self.spark, self.handcrafted, self.backbones, self.pilot = spark, handcrafted, dict(backbones), pilot
        self.alphas, self.cs, self.betas, self.draws = list(alphas), list(cs), list(betas), draws
        widths = {m: d.select(F.max(F.size("features")).alias("n")).first()["n"] for m, d in self.backbones.items()}
        known = {m: MODELS[m] for m in widths if m in MODELS}
        if any(widths[m] != n for m, n in known.items()):
            raise ValueError(f"embedding widths {widths} are not those of the models {known}")
        spec = {"models": widths, "pilot": pilot, "alphas": self.alphas, "cs": self.cs, "betas": self.betas, "draws": draws, "representations": [r for r in REPRESENTATIONS if r in handcrafted.columns]}
        self.study = Study(spark, folder, spec)

    def expected(self) -> DataFrame:
        jobs = expected_jobs(self.spark, list(self.backbones), self.pilot)
        kept = [r for r in REPRESENTATIONS if r in self.handcrafted.columns]
        return jobs.where(F.col("representation").isin(*kept, ""))

    def pairs(self, job: Mapping[str, str]) -> DataFrame:
        """``key, label, split, h, z`` of a job's representation and model, as its context asks."""
        rep, variant, model = job["representation"], job["variant"] or "original", job["model"]
        h = None
        if rep:
            h = self.handcrafted.where(F.col("variant") == variant).select("key", "label", "split", F.col(rep).alias("features"))
        if model == "handcrafted":
            return h.withColumnsRenamed({"features": "h"}).withColumn("z", F.col("h"))
        z = self.backbones[model]
        if h is None:
            return z.select("key", "label", "split", F.col("features").alias("h"), F.col("features").alias("z"))
        rows = A.align(h, z, names=("h", "z")).join(h.select("key", "split"), "key").select("key", "label", "split", "h", "z")
        context = job["context"]
        if context == "within_class":
            train = split_of(rows, "train")
            for side in ("h", "z"):
                rows = A.class_centered(rows, A.class_means(train, side), side)
        elif context.startswith("shuffle"):
            seed = int(context.removeprefix("shuffle") or 0) if context != "shuffled" else 0
            partner = shuffled_partner(rows, "key", seed, ["split"])
            moved = partner.join(rows.select(F.col("key").alias("partner"), "h"), "partner").select("key", "h")
            rows = rows.drop("h").join(moved, "key")
        elif context == "projection":
            width = self.handcrafted.select(F.max(F.size(rep)).alias("n")).first()["n"]
            source = z.select(F.max(F.size("features")).alias("n")).first()["n"]
            rows = L.project(rows, L.gaussian_projection(source, width), "z", "_p").drop("h").withColumnRenamed("_p", "h")
        return rows.select("key", "label", "split", "h", "z")

    # --- select -------------------------------------------------------------------------------

    def select(self) -> int:
        return self.study.select(self.expected(), self._fit)

    def _fit(self, job: dict[str, Any]) -> dict[str, Any]:
        rows = self.pairs(job).persist()
        try:
            train, val = split_of(rows, "train"), split_of(rows, "val")
            if job["kind"] == "ridge":
                x, y = ("h", "z") if job["direction"] == "h_to_z" else ("z", "h")
                ridge, sweep = L.select_ridge(train, val, self.alphas, "native" if x == "h" else "macro", x, y)
                return {"sweep": sweep, "coef": ridge.coef, "intercept": ridge.intercept, "alpha": ridge.alpha, "source_constant": ridge.source_constant}
            if job["model"] == "handcrafted":
                probe, sweep = Q.select_probe(train, val, "h", cs=self.cs, standardize_primary=True)
            elif job["context"] == "standalone":
                probe, sweep = Q.select_probe(train, val, "z", cs=self.cs)
            else:
                probe, sweep = Q.select_probe(train, val, "z", "h", self.cs, self.betas)
            return {"sweep": sweep, "weights": probe.head.weights, "bias": probe.head.bias, "c": probe.c, "beta": probe.beta}
        finally:
            rows.unpersist()

    def lock(self) -> dict[str, Any]:
        return self.study.lock(self.expected(), self._inputs(), self.pilot)

    def _inputs(self) -> dict[str, DataFrame]:
        return {"handcrafted": self.handcrafted, **self.backbones}

    # --- evaluate -----------------------------------------------------------------------------

    def evaluate(self) -> DataFrame:
        """``id, kind, result`` (JSON) of every job on test, and paired comparisons of probes."""
        return self.study.evaluate(self._evaluate, self._inputs())

    def _evaluate(self, done: DataFrame) -> DataFrame:
        import json

        from .sources.tables import to_json

        jobs = {r["id"]: r.asDict() for r in self.expected().collect()}
        fitted = {r["id"]: json.loads(r["result"]) for r in done.collect()}  # a study has a few hundred jobs
        out, p_values = [], []
        for name, job in sorted(jobs.items()):
            test = split_of(self.pairs(job), "test").persist()
            try:
                out.append((name, job["kind"], self._score(job, fitted[name], test)))
                if job["kind"] == "probe" and job["model"] != "handcrafted" and job["context"] != "standalone":
                    alone = f"probe-{job['model']}-standalone"
                    out.append((name, "paired", self._compare(fitted[alone], fitted[name], test)))
                    if job["variant"] == "original" and job["context"] == "combined" and job["representation"] != "imagestats52":
                        p_values.append((name, out[-1][2]["mcnemar_pvalue"]))
            finally:
                test.unpersist()
        if p_values:
            adjusted = Q.holm(self.spark.createDataFrame(p_values, "id string, p double")).collect()
            out += [(r["id"], "holm", {"mcnemar_holm_pvalue": r["p_holm"]}) for r in adjusted]
        return self.spark.createDataFrame([(i, k, to_json(r)) for i, k, r in out], "id string, kind string, result string")

    def _score(self, job: dict[str, Any], found: dict[str, Any], test: DataFrame) -> dict[str, Any]:
        if job["kind"] == "ridge":
            x, y = ("h", "z") if job["direction"] == "h_to_z" else ("z", "h")
            ridge = L.RidgeMap(np.array(found["coef"]), np.array(found["intercept"]), found["alpha"], np.array(found["source_constant"], bool))
            rows = L.apply_map(test, ridge, x)
            scores = L.r2_summary(L.r2_by_position(rows.select(F.col(y).alias("y"), "predicted"))).first().asDict()
            if job["context"] in ("ordinary", "within_class"):
                scores |= L.bootstrap_r2(rows, "key", y, draws=self.draws).first().asDict()
            if job["context"] == "ordinary" and job["direction"] == "h_to_z":
                scores |= {f"cka_{k}": v for k, v in self._geometry(job, test).items()}
            return {"alpha": found["alpha"], **scores}
        return {"c": found["c"], "beta": found["beta"], **H.classification_metrics(self._probabilities(found, test, "p", job["model"] == "handcrafted"), probabilities="p").first().asDict()}

    def _geometry(self, job: dict[str, Any], test: DataFrame) -> dict[str, float]:
        """Linear CKA of the standardised features with the embeddings, and under shuffled rows."""
        train = split_of(self.pairs(job), "train")
        hs = H.standardized(test, *H.scaler(train, "h"), "h")
        out = {"paired": L.linear_cka(hs, "h", "z")}
        for seed in NULL_SEEDS:
            for name, within in (("shuffled", []), ("within_class_shuffled", ["label"])):
                partner = shuffled_partner(hs, "key", seed, within)
                moved = hs.select("key", "z").join(partner, "key").join(hs.select(F.col("key").alias("partner"), "h"), "partner")
                out[f"{name}_{seed}"] = L.linear_cka(moved, "h", "z")
        return out

    def _probabilities(self, found: dict[str, Any], test: DataFrame, out: str, own: bool = False) -> DataFrame:
        head = H.Head(np.array(found["weights"]), np.array(found["bias"]))
        width = head.weights.shape[1]
        x = F.col("h") if own else F.slice(F.concat("z", "h"), 1, width)  # a standalone head reads z only
        return H.predict(test.withColumn("_x", x.cast("array<double>")), head, "_x", "_c", out).drop("_x", "_c")

    def _compare(self, baseline: dict[str, Any], combined: dict[str, Any], test: DataFrame) -> dict[str, Any]:
        rows = self._probabilities(combined, self._probabilities(baseline, test, "b"), "c")
        return Q.paired_metrics(rows, "key", "label", "b", "c", self.draws)

    def pca_reference(self, model: str, representation: str = "frontier33", ranks: Iterable[int] = L.RANKS) -> DataFrame:
        """Reconstruction by rank of a model's embeddings, from the locked ordinary map."""
        import json

        name = f"ridge-{model}-original-{representation}-ordinary-h_to_z"
        found = json.loads(self.study.done().where(F.col("id") == name).first()["result"])
        job = {"model": model, "variant": "original", "representation": representation, "context": "ordinary"}
        rows = self.pairs(job)
        ridge = L.RidgeMap(np.array(found["coef"]), np.array(found["intercept"]), found["alpha"], np.array(found["source_constant"], bool))
        pca = L.fit_pca(split_of(rows, "train"), "z")
        return L.pca_diagnostics(pca, L.apply_map(split_of(rows, "test"), ridge, "h"), "z", ranks=[r for r in ranks if r <= len(pca.mean)])


__all__ = ["OverlapStudy", "baseline_sweep", "final_model", "importance_study", "learning_curves", "two_variants"]
