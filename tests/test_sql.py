"""Every query with SQL, on the smallest tables."""

import pytest

from tests.compare import duck, same
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


#: Too long on one machine for a test (hundreds of rounds of boosting); run by name.
LONG = {"l04_out_of_fold", "l07_rolling_retrain"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LONG - {n for n in QUERIES if n[0] == "p" and n[1].isdigit()}))
def test_runs(spark, name):
    """Queries without SQL run to their end and give the columns they say."""
    df = QUERIES[name](spark, SF)
    assert all(set(r.asDict()) == set(df.columns) for r in df.collect())
