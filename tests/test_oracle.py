"""Every core query against its SQL on the smallest tables."""

import pytest

from emberline.plans import registry
from tests.helpers import same_rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf, duck):
    same_rows(registry.queries()[name](spark, sf), duck, SQL[name])


def test_queries_without_sql_run(spark, sf):
    for name in sorted(set(registry.queries()) - set(SQL)):
        assert registry.queries()[name](spark, sf).count() >= 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
