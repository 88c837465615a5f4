"""Every query against its SQL, and the entry points."""

import pytest
from tests.conftest import SF, rows_of_duck, rows_of_spark

from vellumlake.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_duck(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_index_and_map_form_agree(spark):
    a, b = (QUERIES[n](spark, SF) for n in ("search_index_form", "search_map_form"))
    assert rows_of_spark(a) == rows_of_spark(b)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == "collection id key lang content_md added_at updated_at".split()
    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
