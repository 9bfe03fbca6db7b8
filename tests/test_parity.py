"""Registered queries against their SQL on the smallest tables."""

import pytest
from conftest import SMALL, same_rows

from tallybook.plans.queries import ORACLES, QUERIES

# The sort matrix is one builder; its corners stand for it here.
NAMES = [n for n in ORACLES if not n.startswith("search_sort_") or n in ("search_sort_name_asc", "search_sort_size_desc", "search_sort_last_seen_asc")]


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df())
