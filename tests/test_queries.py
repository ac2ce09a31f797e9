"""Every query of the engine itself against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

from shutterlake import catalog

from .conftest import SF

ORACLE = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, oracle, rows, name):
    got = catalog.queries()[name](spark, SF)
    if name not in ORACLE:
        assert got.schema.fieldNames()
        got.collect()
        return
    assert rows(got.toPandas()) == rows(oracle.sql(ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["asset_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
