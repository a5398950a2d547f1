"""Each query that SQL can say, against SQL; the others are run as a whole."""

import pytest

from tests.conftest import compare
from timeweave.queries import load

BASE = load()


@pytest.mark.parametrize("name", sorted(BASE.SQL))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = compare(spark, duck, BASE.QUERIES[name], BASE.SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(BASE.QUERIES) - set(BASE.SQL)))
def test_query_without_sql_gives_its_rows(spark, name):
    from tests.conftest import SF

    assert BASE.QUERIES[name](spark, SF).collect()
