"""The registered queries against their SQL at the smallest scale; SPECULA_ALL=1 runs every one."""

import os

import pytest

from specula import catalog
from tests.conftest import TESTDATA
from tests.oracle import compare, connect

catalog.load()
QUICK = ["semantic_types", "table_profile", "numeric_stats", "duplicates", "near_duplicates", "functional_dependencies", "dependency_matrix", "kruskal_wallis",
         "numeric_drift", "split_stratified", "impute_by_group", "encode_target", "recipe", "decision_chain", "pattern_absence", "resample", "neighbours_within"]


@pytest.fixture(scope="module")
def duck():
    return connect(TESTDATA)


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", list(catalog.QUERIES) if os.environ.get("SPECULA_ALL") else QUICK)
def test_query_matches_sql(spark, duck, name):
    ok, message, _ = compare(spark, duck, name, catalog.QUERIES[name], catalog.ORACLES.get(name), TESTDATA)
    assert ok, message


def test_entry(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() > 0
