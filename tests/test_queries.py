from __future__ import annotations

import pytest

from leakloom.queries import ORACLE, QUERIES
from oracle import connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, con, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_of_sql(con, ORACLE[name])


def test_entry_has_rows_and_keeps_quiet_repositories(spark, data):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 20
    assert {"repo", "findings", "critical"} <= set(rows[0].asDict())
