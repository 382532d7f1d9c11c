from __future__ import annotations

import pytest

from tests.conftest import SF, duck, same_rows
from tidelog import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    if name in SQL:
        same_rows(got, duck(SF).sql(SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["key", "seq", "tag", "value", "expire_at"] and e.entry(spark).count() > 0
    assert set(SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
