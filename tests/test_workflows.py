import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom import workflows as W
from gridloom.operators.extract import feature_schema
from gridloom.plans.features import FeaturePlan
from gridloom.plans.presets import RGB_BANDS, preset
from gridloom.queries import patches
from gridloom.sources import archives
from gridloom.sources.splits import split_by_number
from gridloom.sources.tables import table


@pytest.fixture(scope="module")
def vectors(spark, data):
    z = split_by_number(table(spark, data, "embeddings"), "vec_id").withColumn("key", F.col("vec_id"))
    signal = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("label") == k).cast("double"))
    rows = z.select("key", (F.col("label") % 4).alias("label"), "split", F.slice(F.col("embedding").cast("array<double>"), 1, 6).alias("v"), signal.alias("s"))
    return rows.select("key", "label", "split", F.concat("v", "s").alias("features")).cache()


def test_variants_differ_in_one_band(spark, data):
    rows = W.two_variants(patches(spark, data, 13), {"frontier33": preset("33"), "imagestats52": preset("52")})
    by = {r.variant: r for r in rows.where("patch_id = 0").collect()}
    names = preset("52").names
    differ = {names[k] for k, (a, b) in enumerate(zip(by["original"].imagestats52, by["b10_zeroed"].imagestats52, strict=True)) if a != b}
    assert differ == {f"{m}_B10" for m in ("mean", "std", "min", "max")}


def test_head_and_curves(spark, vectors):
    head, scores = W.final_model(vectors, "features")
    assert {r["split"] for r in scores.collect()} == {"val", "test"} and (head.weights[0] == 0).all()
    _, records, accuracy = W.baseline_sweep(vectors, "features", (0.1, 10.0))
    assert len(records) == 2 and 0 <= accuracy <= 1
    splits = vectors.select("key", "split")
    rows = W.learning_curves(vectors, "key", {"features": 3.0}, {"random": splits}, percents=(50, 100), seeds=(0, 1))
    assert [(r["percent"], r["runs"]) for r in rows] == [(50, 2), (100, 1)]


def test_importance(spark, vectors):
    schema = feature_schema(spark, FeaturePlan(RGB_BANDS, [f"p{q}_{b}" for b in RGB_BANDS for q in (10, 50, 90)] + ["mean_pan"]))
    found = W.importance_study(vectors, "features", schema, grid=(1.0,), step=3, minimum=4)
    assert [r["features"] for r in found["rounds"]] == [10, 7, 4] and len(found["removed"]) == 6
    assert len(found["importances"]) == 10 and found["importances"][0]["rank"] == 1


def test_overlap_study(spark, vectors, tmp_path):
    crafted = vectors.select("key", "label", "split", F.slice("features", 5, 6).alias("frontier33"))
    both = crafted.withColumn("variant", F.lit("original")).unionByName(crafted.withColumn("variant", F.lit("b10_zeroed")))
    make = lambda pilot, folder: W.OverlapStudy(spark, f"file://{tmp_path}/{folder}", both, {"toy": vectors}, pilot=pilot, alphas=(0.1, 1.0), cs=(1.0,), betas=(0.0, 1.0), draws=10)
    pilot = make(True, "pilot")
    assert pilot.expected().count() == 2 + 1 + 1 + 2
    pilot.select()
    with pytest.raises(ValueError):
        pilot.lock()
    study = make(False, "full")
    assert study.select() == study.expected().count() == 5 * 2 + 3 + 1 + 2
    assert study.select() == 0
    study.lock()
    rows = {(r.id, r.kind): json.loads(r.result) for r in study.evaluate().collect()}
    ordinary = rows["ridge-toy-original-frontier33-ordinary-z_to_h", "ridge"]
    assert ordinary["native_r2"] > 0.99  # the target is part of the source
    assert rows["ridge-toy-original-frontier33-shuffle0-z_to_h", "ridge"]["native_r2"] < 0.1
    geometry = rows["ridge-toy-original-frontier33-ordinary-h_to_z", "ridge"]
    assert geometry["cka_paired"] > geometry["cka_shuffled_0"]
    assert 0 <= rows["probe-toy-original-frontier33-combined", "holm"]["mcnemar_holm_pvalue"] <= 1
    assert rows["probe-toy-original-frontier33-shuffled", "paired"]["n"] == 100
    ranks = study.pca_reference("toy").collect()
    assert {r["rank"] for r in ranks} == {1, 2, 4, 8}


def test_fetch_and_unpack(tmp_path):
    source = tmp_path / "a.zip"
    with zipfile.ZipFile(source, "w") as z:
        z.writestr("in/a.txt", "abc")
    digest = hashlib.sha256(source.read_bytes()).hexdigest()
    got = archives.fetch(source.as_uri(), str(tmp_path / "b.zip"), digest)
    with pytest.raises(ValueError):
        archives.fetch(source.as_uri(), str(tmp_path / "c.zip"), "0" * 64)
    assert not (tmp_path / "c.zip").exists()
    assert len(archives.unpack(got, str(tmp_path / "out"))) == 1 and archives.unpack(got, str(tmp_path / "out")) == []
    for name in ("../x", "/x"):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
            z.writestr(name, "x")
        with pytest.raises(ValueError):
            archives.unpack(str(tmp_path / "bad.zip"), str(tmp_path / "out"))
