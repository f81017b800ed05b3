"""Each query with a SQL twin gives the rows that DuckDB gives."""

import pytest
from oracle import DATA, compare

from scriptorium.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], DATA)
