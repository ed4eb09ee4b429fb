"""Every registered query of the fire analysis: against its SQL where there is one, else it must run and give rows."""

from __future__ import annotations

import pytest

from burncal.plans import registry
from tests.conftest import SF
from tests.oracle import compare

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name], SF) >= 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
