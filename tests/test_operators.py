import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import draws as R
from gridloom.operators import alignment as A
from gridloom.operators import decoding as L
from gridloom.operators import families as M
from gridloom.operators import heads as H
from gridloom.operators import probes as Q
from gridloom.operators.extract import extract
from gridloom.plans.features import FeaturePlan

RNG = np.random.default_rng(1)


def vectors(spark, x, y=None, label=None):
    rows = [(k, int(label[k]) if label is not None else 0, [float(v) for v in x[k]], [float(v) for v in (y[k] if y is not None else x[k])]) for k in range(len(x))]
    return spark.createDataFrame(rows, "key long, label int, x array<double>, y array<double>")


# --- extraction ---------------------------------------------------------------------------------


def patch_rows(spark, images, ids=None):
    rows = [(k, int(i.shape[1]), int(i.shape[2]), [[float(v) for v in b.ravel()] for b in i], "kept") for k, i in enumerate(images)]
    return spark.createDataFrame(rows, "patch_id long, h int, w int, bands array<array<double>>, note string")


def test_both_engines_agree_on_any_size(spark):
    plan = FeaturePlan(["red", "green", "blue", "nir"])
    images = [np.floor(RNG.random((4, 18, 21)) * 1000) for _ in range(3)]
    rows = patch_rows(spark, images)
    arrow = {r.patch_id: r.features for r in extract(rows, plan).collect()}
    for r in M.features_long(rows, plan, 18, 21).collect():
        assert r.value == pytest.approx(arrow[r.patch_id][r.pos], rel=1e-8, abs=1e-8), plan.names[r.pos]


def test_extract_keeps_columns_and_mixes_sizes(spark):
    rows = patch_rows(spark, [np.ones((1, 16, 16)), np.ones((1, 20, 18)) * 2])
    out = extract(rows, {"a": FeaturePlan(["red"], ["mean_red"]), "b": FeaturePlan(["red"], ["max_red", "max_red"])})
    assert out.columns == ["patch_id", "h", "w", "note", "a", "b"]
    assert [(r.a, r.b, r.note) for r in out.orderBy("patch_id").collect()] == [([1.0], [1.0, 1.0], "kept"), ([2.0], [2.0, 2.0], "kept")]
    assert extract(rows.limit(0), FeaturePlan(["red"])).count() == 0
    zeroed = extract(rows, FeaturePlan(["red"], ["mean_pan"]), zero_bands=("red",)).first()
    assert zeroed.features == [0.0]


def test_extract_refuses_bad_patches(spark):
    plan = FeaturePlan(["red"], ["mean_red"])
    short = spark.createDataFrame([(0, 16, 16, [[1.0] * 255])], "patch_id long, h int, w int, bands array<array<double>>")
    for bad in (short, patch_rows(spark, [np.full((1, 16, 16), np.inf)])):
        with pytest.raises(Exception, match="hold"):
            extract(bad, plan).collect()


# --- alignment and draws ---------------------------------------------------------------------------


def test_align_checks(spark):
    def rows(keys, label=0, v=1.0):
        return spark.createDataFrame([(k, label, [v]) for k in keys], "key string, label int, features array<double>")

    good = A.align(rows("abc"), rows("cba", v=2.0)).orderBy("key").collect()
    assert [(r.key, r.x, r.y) for r in good] == [(k, [1.0], [2.0]) for k in "abc"]
    for left, right, fault in (
        (rows("aab"), rows("ab"), "duplicate_left"), (rows("ab"), rows("abb"), "duplicate_right"), (rows("abc"), rows("ab"), "only_left"), (rows("a"), rows("ab"), "only_right"),
        (rows("a"), rows("a", label=1), "label_mismatch"), (rows("a"), rows("a", v=math.nan), "not_finite"),
    ):
        with pytest.raises(ValueError, match=fault):
            A.align(left, right)


def test_positions_are_a_ranking_over_many_tasks(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("d", R.draw(1, F.col("id")))
    all_ = R.positions(df, ["d", "id"]).collect()
    assert [r.id for r in sorted(all_, key=lambda r: r.rank)] == [r.id for r in sorted(all_, key=lambda r: (r.d, r.id))]
    assert sorted(r.rank for r in all_) == list(range(1, 1001))
    for g in range(3):
        part = [r for r in R.positions(df, ["d", "id"], ["g"]).collect() if r.g == g]
        assert [r.id for r in sorted(part, key=lambda r: r.rank)] == [r.id for r in sorted(part, key=lambda r: (r.d, r.id))]


def test_nested_subsets_and_resamples(spark):
    df = spark.range(200).withColumn("label", F.col("id") % 4)
    sets = [{r.id for r in R.nested_subset(df, "id", f, 5).collect()} for f in (0.1, 0.5, 1.0)]
    assert [len(s) for s in sets] == [20, 100, 200] and sets[0] < sets[1] < sets[2]
    shuffled = R.shuffled_partner(df, "id", 3, ["label"]).collect()
    assert {r.partner for r in shuffled} == set(range(200)) and all(r.id % 4 == r.partner % 4 for r in shuffled)
    m = R.multiplicities(df, "row", 200, 20).collect()
    assert sum(r.n for r in m) == 20 * 200
    assert 0.55 < len(m) / 4000 < 0.72  # 1 - 1/e of the rows are drawn


# --- heads ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    label = np.arange(240) % 3
    x = RNG.normal(size=(240, 5)) + np.eye(5)[label] * 2
    x[:, 4] = 7.0  # constant
    return x, label, vectors(spark, x, label=label)


def test_head_is_stationary_in_raw_units(blobs):
    x, label, df = blobs
    head = H.fit(df, 1.0, "x")
    mean, std = x.mean(0), x.std(0)
    std[4] = 1
    s = (x - mean) / std
    z = s @ head.standardized.T + head.bias + head.weights @ mean
    p = H.softmax(z) - np.eye(3)[label]
    assert np.abs(p.T @ s / 240 + head.standardized / 240).max() < 1e-5
    assert np.abs(p.sum(0) / 240).max() < 1e-5
    assert np.allclose(H.softmax(head.logits(x)), H.softmax(z))
    assert np.allclose(H.softmax(head.shifted(1).logits(x)), H.softmax(z))
    assert head.shifted(1).stored_parameters() == 2 * 6


def test_predict_and_metrics(spark, blobs):
    x, label, df = blobs
    head = H.fit(df, 3.0, "x")
    want = head.logits(x).argmax(1)
    got = H.predict(df, head, "x", probabilities="p").orderBy("key").collect()
    assert [r.prediction for r in got] == want.tolist()
    m = H.classification_metrics(H.predict(df, head, "x", probabilities="p"), probabilities="p").first()
    p = H.softmax(head.logits(x))[np.arange(240), label]
    assert m.accuracy == pytest.approx((want == label).mean()) and m.log_loss == pytest.approx(-np.log(p).mean())
    tie = H.Head(np.zeros((3, 5)), np.zeros(3))
    assert {r.prediction for r in H.predict(df, tie, "x").collect()} == {0}


def test_sweep_and_elimination(blobs):
    _, _, df = blobs
    train, val = df.where("key % 4 < 3"), df.where("key % 4 = 3")
    _, records = H.sweep(train, val, (10.0, 0.1, 1.0), "x")
    chosen = [r for r in records if r["selected"]]
    assert len(chosen) == 1 and chosen[0]["accuracy"] == max(r["accuracy"] for r in records)
    assert chosen[0]["c"] == min(r["c"] for r in records if r["accuracy"] == chosen[0]["accuracy"])
    rounds, gone = H.eliminate(train, val, step=2, minimum=1, grid=(1.0,), vector="x")
    assert [r["features"] for r in rounds] == [5, 3, 1] and gone[0] == 4  # the constant goes first
    with pytest.raises(ValueError):
        H.eliminate(train, val, step=3, minimum=1, grid=(1.0,), vector="x")
    with pytest.raises(H.NotConverged):
        H.fit(train, 1e6, "x", max_iter=1)


# --- decoding -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def mapped(spark):
    x = RNG.normal(size=(200, 6)) * [1, 10, 1, 1, 1, 0] + 5
    y = x @ RNG.normal(size=(6, 3)) + 0.1 * RNG.normal(size=(200, 3))
    return x, y, vectors(spark, x, y)


@pytest.mark.parametrize("scoring", ["native", "macro"])
def test_ridge_against_least_squares(mapped, scoring):
    x, y, df = mapped
    train, val = df.where("key % 4 < 3"), df.where("key % 4 = 3")
    ridge, records = L.select_ridge(train, val, (1e-6, 0.01, 1.0, 100.0), scoring)
    t, v = np.arange(200) % 4 < 3, np.arange(200) % 4 == 3
    live = [0, 1, 2, 3, 4]
    m, s = x[t][:, live].mean(0), x[t][:, live].std(0)
    design, held = (x[t][:, live] - m) / s, (x[v][:, live] - m) / s
    for r in records:
        w = np.linalg.solve(design.T @ design + t.sum() * r["alpha"] * np.eye(5), design.T @ (y[t] - y[t].mean(0)))
        err = ((y[v] - y[t].mean(0) - held @ w) ** 2).sum(0)
        sst = ((y[v] - y[v].mean(0)) ** 2).sum(0)
        assert r["validation_score"] == pytest.approx(1 - err.sum() / sst.sum() if scoring == "native" else 1 - (err / sst).mean(), abs=1e-9)
        if r["selected"]:
            assert np.allclose(ridge.coef[live], w / s[:, None], atol=1e-8) and (ridge.coef[5] == 0).all()
    assert ridge.source_constant.tolist() == [False] * 5 + [True]
    got = np.array([r.predicted for r in L.apply_map(df, ridge).orderBy("key").collect()])
    assert np.allclose(got, x @ ridge.coef + ridge.intercept)


def test_ridge_ties_favour_the_larger_alpha(spark):
    x = RNG.normal(size=(40, 2))
    df = vectors(spark, x, np.tile([[1.0, 2.0]], (40, 1)) + np.arange(40)[:, None] % 2 * 0)
    with pytest.raises(ValueError, match="constant"):
        L.select_ridge(df, df, (1.0,))
    with pytest.raises(ValueError):
        L.select_ridge(df, df, (-1.0,))


def test_r2_with_a_constant_target(spark):
    y = np.c_[RNG.normal(size=50), np.full(50, 3.0)]
    df = vectors(spark, y + 0.1, y).withColumnRenamed("x", "predicted")
    rows = {r.pos: r.r2 for r in L.r2_by_position(df).collect()}
    assert rows[1] is None and rows[0] == pytest.approx(1 - 0.01 * 50 / ((y[:, 0] - y[:, 0].mean()) ** 2).sum())
    s = L.r2_summary(L.r2_by_position(df)).first()
    assert (s.defined_features, s.undefined_features) == (1, 1)


def test_cka_and_pca(mapped):
    x, y, df = mapped
    a, b = x - x.mean(0), y - y.mean(0)
    want = ((a.T @ b) ** 2).sum() / (np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b))
    assert L.linear_cka(df) == pytest.approx(want)
    assert L.linear_cka(df, "x", "x") == pytest.approx(1)
    pca = L.fit_pca(df)
    values = np.linalg.eigvalsh(np.cov(y.T))[::-1]
    assert np.allclose(pca.variance, values)
    rows = {r["rank"]: r for r in L.pca_diagnostics(pca, df.withColumn("predicted", F.col("y")), ranks=[0, 1, 3]).collect()}
    assert rows[1].training_variance_fraction == pytest.approx(values[0] / values.sum())
    assert rows[1].oracle_reconstruction_r2 == pytest.approx(values[0] / values.sum())
    assert rows[3].prediction_reconstruction_r2 == pytest.approx(1) and rows[0].oracle_reconstruction_r2 == pytest.approx(0, abs=1e-9)


def test_bootstrap_covers_the_score(mapped):
    _, y, df = mapped
    rows = df.withColumns({"predicted": F.transform("y", lambda v: v * 0.9), "baseline": F.transform("y", lambda v: v * 0.5)})
    whole = L.r2_summary(L.r2_by_position(rows)).first().native_r2
    r = L.bootstrap_r2(rows, "key", draws=60).first()
    assert r.native_ci_low <= whole <= r.native_ci_high and r.bootstrap_defined == 60
    same = L.paired_r2(rows, "key", "y", "predicted", "predicted", 20).first()
    assert same.delta_r2 == same.delta_ci_low == same.delta_ci_high == 0
    assert L.paired_r2(rows, "key", "y", "baseline", "predicted", 20).first().delta_r2 > 0


# --- probes and tests ---------------------------------------------------------------------------------


def test_block_scaling(spark):
    x = RNG.normal(size=(100, 4)) * [1, 2, 3, 0] + 1
    df = vectors(spark, x)
    z = Q.block(df, "x", True)
    got = np.array([r.v for r in df.orderBy("key").select(z.column(F.col("x")).alias("v")).collect()])
    assert np.allclose(got, (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0) / np.sqrt(3))
    c = Q.block(df, "x", False)
    assert c.scale == pytest.approx(np.linalg.norm(x[:, :3].std(0)))


def test_probe_folds_back_to_raw_units(blobs):
    x, label, df = blobs
    train, val = df.where("key % 4 < 3"), df.where("key % 4 = 3")
    both = (train.withColumn("y", F.transform("x", lambda v: v * 3)), val.withColumn("y", F.transform("x", lambda v: v * 3)))
    probe, records = Q.select_probe(*both, "x", "y", cs=(1.0, 10.0), betas=(1.0, 0.0))
    assert [r["beta"] for r in records] == [0.0, 0.0, 1.0, 1.0] and sum(r["selected"] for r in records) == 1
    assert probe.head.weights.shape == (3, 10)
    if probe.beta == 0:
        assert (probe.head.weights[:, 5:] == 0).all()


@pytest.mark.parametrize(("gained", "lost"), [(0, 0), (5, 5), (9, 1), (0, 12), (200, 150)])
def test_mcnemar(spark, gained, lost):
    n = gained + lost
    want = min(1.0, 2 * sum(math.comb(n, k) for k in range(min(gained, lost) + 1)) / 2**n) if n else 1.0
    got = spark.range(1).select(Q.mcnemar_pvalue(F.lit(gained), F.lit(lost)).alias("p")).first().p
    assert got == pytest.approx(want, rel=1e-9)


def test_mcnemar_of_more_pairs_than_its_sql_lists(spark):
    n, low = 12_200, 6_000  # the query's SQL lists factorials to 4,999 and says 1 beyond
    middle = sum(math.comb(n, k) for k in range(low + 1, n - low))
    want = (2**n - middle) / 2**n
    got = spark.range(1).select(Q.mcnemar_pvalue(F.lit(low), F.lit(n - low)).alias("p")).first().p
    assert 0.07 < want < 0.08 and got == pytest.approx(want, rel=1e-9)


def test_holm_keeps_ties_in_order(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.04]
    got = [r.p_holm for r in Q.holm(spark.createDataFrame(list(enumerate(p)), "id int, p double")).orderBy("id").collect()]
    assert got == pytest.approx([0.04, 0.09, 0.09, 0.025, 0.09])


def test_paired_metrics(spark):
    rows = [(k, k % 2, [0.6, 0.4] if k < 40 else [0.3, 0.7], [0.8, 0.2] if k % 2 == 0 else [0.1, 0.9]) for k in range(80)]
    df = spark.createDataFrame(rows, "key long, label int, b array<double>, c array<double>")
    m = Q.paired_metrics(df, "key", "label", "b", "c", draws=20)
    assert (m["gained_correct"], m["lost_correct"], m["both_correct"], m["both_wrong"]) == (40, 0, 40, 0)
    assert m["accuracy_delta"] == pytest.approx(0.5) and m["relative_error_reduction"] == 1 and m["mcnemar_pvalue"] < 1e-9
    assert m["accuracy_ci_low"] <= 0.5 <= m["accuracy_ci_high"] and m["log_loss_improvement"] > 0


def test_definitions_of_unknown_names(spark):
    from gridloom.operators.reports import physical_definition

    def text(name):
        return spark.createDataFrame([(name,)], "n string").select(physical_definition(F.col("n"))).first()[0]

    assert text("corr_B04_B08") == "B04;B08" and text("mean_B8A") == "B8A" and text("corr_ndvi_pan").startswith("(B08 - B04)") and text(None) is None
    for name in ("mean_B13", "nothing"):
        with pytest.raises(Exception, match="no definition"):
            text(name)
