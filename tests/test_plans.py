import pytest

from gridloom.plans.features import FeaturePlan, parse_feature, resolve_roles
from gridloom.plans.presets import BANDS_13, RGB_BANDS, preset, rgb_preset
from gridloom.plans.study import Study, expected_jobs

SIX = ("B02", "B03", "B04", "B08", "B11", "B12")


@pytest.mark.parametrize(
    ("bands", "n"),
    [(RGB_BANDS, 162), ((*RGB_BANDS, "nir"), 218), (tuple(f"SR_B{k}" for k in range(1, 8)), 337), (BANDS_13, 481), (("VV", "VH"), 63), (SIX, 313)],
)
def test_default_counts(bands, n):
    names = FeaturePlan(bands).names
    assert len(names) == n == len(set(names))


def test_presets():
    sizes = {k: len(preset(k).names) for k in ("33", "52", "377", "389")}
    assert sizes == {"33": 33, "52": 52, "377": 377, "389": 389}
    pool = preset("377").names
    assert len(set(pool)) == 369  # eight correlations stand twice
    assert preset("389").names[:377] == pool
    assert preset("377").roles["swir1"] == "B12" and preset("377").roles["swir2"] == "B8A"
    assert len(rgb_preset("moments").names) == 12 and len(rgb_preset("33").names) == 33
    with pytest.raises(ValueError):
        preset("34")


def test_parsing():
    channels = {"B04", "B08", "ndvi", "pan", "s1_x"}
    assert parse_feature("grad_mean_s2_B04", channels)[:3] == ("grad_mean", 2, "B04")
    assert parse_feature("corr_B04_B08", channels) == ("corr", 0, "B04", "B08")
    assert parse_feature("std_s1_x", channels)[:3] == ("std", 0, "s1_x")  # a channel's name goes first
    assert parse_feature("tail_aniso_low_ndvi", channels).family == "tail"
    for bad in ("mean", "mean_B99", "corr_B04_B99", "nothing_B04", "mean_s_B04"):
        with pytest.raises(ValueError):
            parse_feature(bad, channels)


def test_roles_and_checks():
    assert resolve_roles(["Red", "B03", "b"]) == {"blue": "b", "green": "B03", "red": "Red"}
    assert "red" not in resolve_roles(["red"], {"red": None})
    for bad in ({"purple": "red"}, {"red": "B9"}):
        with pytest.raises(ValueError):
            resolve_roles(["red"], bad)
    for bands in (["a", "a"], ["pan"], ["ndvi"], []):
        with pytest.raises(ValueError):
            FeaturePlan(bands)
    with pytest.raises(ValueError):
        FeaturePlan(["a"], ["mean_s3_a"]).check_size(16, 16)
    with pytest.raises(ValueError):
        FeaturePlan(["a"]).check_size(15, 64)


def test_groups_hold_only_what_is_named():
    plan = FeaturePlan(["red", "nir"], ["mean_red", "std_ndvi", "grad_mean_s1_nir", "corr_red_nir"])
    assert set(plan.groups) == {("moments", 0), ("gradient", 1), ("correlation", 0)}
    assert plan.groups["moments", 0] == (["red", "ndvi"], ["mean", "std"])
    assert plan.channels_at(1) == ["nir"]


def test_jobs(spark):
    jobs = expected_jobs(spark)
    assert jobs.count() == jobs.select("id").distinct().count() == 249
    assert jobs.where("kind = 'ridge'").count() == 190
    assert expected_jobs(spark, ["resnet50"], pilot=True).count() == 2 + 1 + 2 + 1


def test_study_resumes_locks_and_evaluates(spark, tmp_path):
    expected = expected_jobs(spark, ["resnet50"], pilot=True)
    study = Study(spark, f"file://{tmp_path}/study", {"alphas": [1.0, float("inf")]})
    assert study.left(expected).count() == 6
    done = []
    with pytest.raises(RuntimeError):
        study.select(expected, lambda job: done.append(job["id"]) or {"score": 1.0} if len(done) < 2 else (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(ValueError):
        study.lock(expected)
    assert study.select(expected, lambda job: {"score": float("nan")}) == 4
    with pytest.raises(RuntimeError):
        study.evaluate(lambda d: d)
    with pytest.raises(ValueError):
        study.lock(expected, pilot=True)
    study.lock(expected, {"jobs": expected})
    with pytest.raises(RuntimeError):
        study.select(expected, lambda job: {})
    with pytest.raises(ValueError):
        study.evaluate(lambda d: d, {"jobs": expected.limit(2)})
    assert study.evaluate(lambda d: d, {"jobs": expected}).count() == 6
    with pytest.raises(ValueError):
        Study(spark, f"file://{tmp_path}/study", {"alphas": [2.0]}).open()
