"""Shapes of physical plans: exchanges, pushed columns, narrow passes."""

import re

import pytest

from gridloom.operators import families as M
from gridloom.operators.extract import extract
from gridloom.plans.features import FeaturePlan
from gridloom.plans.presets import preset
from gridloom.queries import BANDS_6
from gridloom.sources.patches import lattice_patches
from gridloom.sources.tables import table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?!.*REUSED)", plan_of(df)))


@pytest.fixture(scope="module")
def stored_patches(spark, data, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('patches')}/p"
    lattice_patches(table(spark, data, "embeddings"), 6).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("family", list(M.BUILDERS))
def test_a_family_has_one_exchange(stored_patches, family):
    assert exchanges(M.family(stored_patches, FeaturePlan(BANDS_6), family, ["B02", "ndvi"], 16, 16)) == 1


def test_extraction_is_one_narrow_pass(stored_patches):
    found = extract(stored_patches, FeaturePlan(BANDS_6))
    assert exchanges(found) == 0
    assert "ReadSchema: struct<patch_id:bigint,h:int,w:int,bands" in plan_of(found)


def test_pooling_adds_one_exchange_a_level(stored_patches):
    plan = FeaturePlan(BANDS_6)
    counts = [exchanges(M.family(stored_patches, plan, "gradient", ["ndvi"], 16, 16, s)) for s in (0, 1, 2)]
    assert counts == [1, 2, 3]


def test_presets_plan_one_kernel_a_family_and_scale():
    plan = preset("33")
    assert len(plan.groups) == len({(f.family, f.scale) for f in plan.features}) < len(plan.names)
