import pytest

from tests.compare import compare, duck
from voxlake.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_the_oracle(spark, con, name):
    compare(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs_and_has_rows(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES) and catalog.FLAGSHIP in QUERIES


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
