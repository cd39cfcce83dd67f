"""Every registered query runs; those with SQL equal DuckDB's result."""

import pytest
from helpers import same_rows

from breathline import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(name, spark, sf, duck):
    rows = registry.queries()[name](spark, sf).collect()
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert rows and sorted(rows[0].asDict()) == sorted(columns)
    assert same_rows(rows, columns, result.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
