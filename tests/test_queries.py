"""Every query against its SQL on the smallest tables."""

import pytest
from conftest import DATA, same_rows

from quarryline.plans.catalogue import FLAGSHIP, QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    QUERIES[name](spark, DATA).collect()


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
