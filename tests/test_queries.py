"""Every lake query against the SQL that it stands for."""

import pytest
from compare import SF, duck, spark_rows

import tarn.relational  # noqa: F401
from tarn import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    got = spark_rows(Q.QUERIES[name](spark, SF))
    if name in Q.SQL:
        assert got == duck(Q.SQL[name])
    else:
        assert got[1]


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
