"""Text queries beside their DuckDB twins."""

import pytest

from tallybook.llm import registered
from tools.compare import differences, duck_views


def test_every_twin_has_a_query():
    assert set(registered.ORACLES) <= set(registered.QUERIES)


@pytest.mark.parametrize("key", sorted(registered.ORACLES))
def test_same_as_duckdb(spark, sf_dir, key):
    ours = registered.QUERIES[key](spark, sf_dir)
    assert differences(ours, ours.collect(), duck_views(sf_dir).execute(registered.ORACLES[key])) is None
