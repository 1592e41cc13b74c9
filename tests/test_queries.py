"""Every registered query, and its result against the SQL where there is any."""

import os

import duckdb
import pytest

from gridloom.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sql, data, name):
    found = QUERIES[name](spark, data)
    columns = sorted(found.columns)
    run = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in run.fetchall()]
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert len(got) == len(want) > 0
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["feature_vector_377", "feature_vector_389_two_variants", "ridge_select", "ridge_decode", "pca_fit"])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
