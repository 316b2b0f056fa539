"""Every registered query beside its DuckDB twin, or at least once."""

import pytest

from tallybook import registry
from tools.compare import differences, duck_views

QUERIES, ORACLES = registry.all_queries(), registry.all_oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return duck_views(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_as_duckdb(spark, duck, sf_dir, key):
    ours = QUERIES[key](spark, sf_dir)
    assert differences(ours, ours.collect(), duck.execute(ORACLES[key])) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES) - {"tpc_runner", "an_feature_interactions"}))
def test_runs(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).count() > 0
