"""Study protocol: the jobs of a study as a table, resumable stages, a lock before the test split.

Jobs and results are tables in one folder, specification and lock are JSON files. A stage runs
the jobs that are expected and not yet done (an anti-join), so it can be stopped and resumed.
The lock records hashes of everything selected and is refused unless every expected job is done;
evaluation reads the lock only and checks the hashes again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables

# Fixed values of the study.
MODELS = {"resnet50": 2048, "convnext_tiny": 768, "dofa_large": 1024, "olmoearth_nano": 128, "olmoearth_base": 768}
REPRESENTATIONS = {"frontier33": 33, "pool377": 377, "imagestats52": 52}
VARIANTS = ("original", "b10_zeroed")
NULL_SEEDS = (0, 1, 2)
DRAWS = 200
JOB_PARTS = ["kind", "model", "variant", "representation", "context", "direction"]


def job_name(*parts: Column) -> Column:
    """Parts that are not empty, joined by dashes."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "-")


def _rows(spark: SparkSession, name: str, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def expected_jobs(spark: SparkSession, models: list[str] | None = None, pilot: bool = False) -> DataFrame:
    """All jobs of a study: ``id`` and its parts, from small dimension tables.

    Ridge maps go both ways between each representation and model, ordinary and under null
    controls; probes are standalone, combined, and (original variant only) with shuffled or
    projected extras. A second variant exists for the models that see the zeroed band; a pilot
    keeps one representation and the ordinary contexts.
    """
    models = list(MODELS if models is None else models)
    both = [(v, r) for v in VARIANTS for r in REPRESENTATIONS if (r == "frontier33" or not pilot) and (v == "original" or r != "imagestats52")]
    variants = spark.createDataFrame(both, "variant string, representation string")
    sees_zeroed = F.col("model").startswith("olmoearth") | (F.col("variant") == "original")
    pairs = _rows(spark, "model", models).join(variants, sees_zeroed) if models else variants.withColumn("model", F.lit("")).limit(0)
    contexts = ["ordinary"] if pilot else ["ordinary", "within_class", *(f"shuffle{s}" for s in NULL_SEEDS)]
    each = lambda c, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(c)
    ridge = pairs.select("*", each("context", contexts)).select("*", each("direction", ["h_to_z", "z_to_h"])).withColumn("kind", F.lit("ridge"))
    extra = F.when((F.col("variant") == "original") & F.lit(not pilot), F.array(F.lit("combined"), F.lit("shuffled"), F.lit("projection"))).otherwise(F.array(F.lit("combined")))
    probes = pairs.select("*", F.explode(extra).alias("context")).withColumns({"kind": F.lit("probe"), "direction": F.lit("")})
    alone = _rows(spark, "model", models).withColumns({"kind": F.lit("probe"), "variant": F.lit(""), "representation": F.lit(""), "context": F.lit("standalone"), "direction": F.lit("")})
    crafted = variants.withColumns({"kind": F.lit("probe"), "model": F.lit("handcrafted"), "context": F.lit(""), "direction": F.lit("")})
    parts = [d.select(*JOB_PARTS) for d in (ridge, probes, alone, crafted)]
    jobs = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return jobs.select(job_name(*[F.col(c) for c in JOB_PARTS]).alias("id"), *JOB_PARTS)


class Study:
    """A study's folder: ``spec.json``, ``jobs/``, ``lock.json``, ``results/``."""

    def __init__(self, spark: SparkSession, folder: str, spec: dict[str, Any]):
        self.spark, self.folder, self.spec = spark, folder.rstrip("/"), tables.plain(spec)

    def _at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    @property
    def locked(self) -> bool:
        return tables.exists(self.spark, self._at("lock.json"))

    def open(self) -> None:
        """Record the specification, or check that it is the recorded one."""
        if not tables.exists(self.spark, self._at("spec.json")):
            tables.write_json(self.spark, self._at("spec.json"), self.spec)
        elif tables.read_json(self.spark, self._at("spec.json")) != self.spec:
            raise ValueError("the folder belongs to a study with another specification")

    def done(self) -> DataFrame:
        """``id, result`` (JSON) of the jobs done so far."""
        schema = "id string, result string"
        if not tables.exists(self.spark, self._at("jobs")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at("jobs"))

    def left(self, expected: DataFrame) -> DataFrame:
        return expected.join(self.done().select("id"), "id", "left_anti")

    def select(self, expected: DataFrame, work: Callable[[dict[str, Any]], Any]) -> int:
        """Run the jobs that are left, each stored when it ends; how many were run."""
        self.open()
        if self.locked:
            raise RuntimeError("the study is locked; nothing more may be selected")
        left = sorted(self.left(expected).collect(), key=lambda r: r["id"])  # a study has a few hundred jobs
        for job in left:
            result = tables.to_json(work(job.asDict()))
            self.spark.createDataFrame([(job["id"], result)], "id string, result string").coalesce(1).write.mode("append").parquet(self._at("jobs"))
        return len(left)

    def coverage(self, expected: DataFrame) -> dict[str, list[str]]:
        """Ids that are missing, unexpected or repeated."""
        done = self.done()
        ids = lambda d: sorted(r["id"] for r in d.select("id").distinct().collect())
        return {
            "missing": ids(self.left(expected)),
            "unexpected": ids(done.join(expected.select("id"), "id", "left_anti")),
            "repeated": ids(done.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")),
        }

    def lock(self, expected: DataFrame, inputs: dict[str, DataFrame] | None = None, pilot: bool = False) -> dict[str, Any]:
        """Freeze the selection: hashes of the specification, the jobs and the inputs."""
        if pilot:
            raise ValueError("a pilot is not locked")
        if self.locked:
            raise RuntimeError("the study is locked already")
        self.open()
        faults = {k: v for k, v in self.coverage(expected).items() if v}
        if faults:
            raise ValueError(f"jobs do not match what is expected: {faults}")
        lock = self._hashes(inputs or {})
        tables.write_json(self.spark, self._at("lock.json"), lock)
        return lock

    def _hashes(self, inputs: dict[str, DataFrame]) -> dict[str, Any]:
        return {
            "spec": tables.fingerprint(self.spec),
            "jobs": tables.content_fingerprint(self.done()),
            "inputs": {k: tables.content_fingerprint(v) for k, v in sorted(inputs.items())},
        }

    def evaluate(self, work: Callable[[DataFrame], DataFrame], inputs: dict[str, DataFrame] | None = None) -> DataFrame:
        """Results of the locked jobs, stored; anything that changed since the lock is an error."""
        if not self.locked:
            raise RuntimeError("lock the study before its test split is used")
        if tables.read_json(self.spark, self._at("lock.json")) != tables.plain(self._hashes(inputs or {})):
            raise ValueError("specification, jobs or inputs changed after the lock")
        work(self.done()).write.mode("overwrite").parquet(self._at("results"))
        return self.spark.read.parquet(self._at("results"))
