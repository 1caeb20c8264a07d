"""Every query of the feature jobs against its DuckDB twin, over whole tables."""

from __future__ import annotations

import pytest

from tests.oracle import connection, same
from tidemark.plans import catalog, models, monitoring, more

QUERIES = catalog.QUERIES | more.QUERIES | monitoring.QUERIES | models.QUERIES
ORACLES = catalog.ORACLES | more.ORACLES | monitoring.ORACLES | models.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"ml_hgb"}))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_without_text_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
