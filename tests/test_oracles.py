"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import oracle
import pytest

from purselake.plans import registry

FOLDER = os.environ.get("PURSELAKE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    found = oracle.difference(registry.QUERIES[name](spark, FOLDER), con, registry.ORACLE_SQL[name])
    assert found in ("", "no rows"), found


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", ["M08_agency_concentration", "M15_district_programs", "W08_boolean_first", "M13_budget_trajectory"])
def test_row_order_does_not_matter(spark, name, tmp_path):
    for t in oracle.TABLES:
        spark.read.parquet(f"{FOLDER}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = [oracle.rows_of(d.columns, [tuple(r) for r in d.collect()]) for d in (registry.QUERIES[name](spark, f) for f in (FOLDER, str(tmp_path)))]
    assert rows[0] == rows[1]
