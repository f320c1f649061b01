"""Every engine query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from quarrylog.oracle import DETAIL_CTE, ORACLE_SQL
from quarrylog.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, "/root/testdata/sf0.001"), ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_append_holds_all_patterns(spark, same_as_sql):
    """No record is left out: the combined table has each pattern of the whole log once, and some on either side."""
    rows = QUERIES["database_append"](spark, "/root/testdata/sf0.001")
    same_as_sql(rows.select("Severity", "Type/Source", "Description"), f'WITH {DETAIL_CTE} SELECT "Severity", "Type/Source", "Description" FROM detail')
    counts = QUERIES["append_counts"](spark, "/root/testdata/sf0.001").first()
    assert 0 < counts.new_rows < counts.total_rows == rows.count()
