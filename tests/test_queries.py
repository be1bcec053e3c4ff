"""Each registered query against its SQL, on the smallest tables; those without SQL give rows."""

import __spark_entry__ as entry
import pytest
from conftest import rows_of
from lectern import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    if sql := plans.ORACLE_SQL.get(name):
        assert rows_of(got) == rows_of(duck.execute(sql).df())
    else:
        assert len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
