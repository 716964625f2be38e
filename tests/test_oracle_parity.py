"""Every registered query with an oracle statement matches DuckDB (sf0.001;
set ALERTSPARK_ORACLE_SF to run at another scale)."""
import os

import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from oracle import compare, duck

SF = os.environ.get("ALERTSPARK_ORACLE_SF", SF_SMALL)
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    problems, _ = compare(df, con, ORACLE[name])
    assert not problems, problems


def test_every_query_runs_and_entry(spark):
    names = sorted(set(E.queries()) - set(ORACLE))
    for name in names:
        E.queries()[name](spark, SF).count()
    assert E.entry(spark).count() >= 0
