import pytest
from oracle import difference, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    frame = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(frame, con.sql(entry.oracle_sql()[name]).df()) is None
