from pathlib import Path

import pytest
from conftest import SF

from zenithal import queries as library

QUERIES, ORACLES = library.queries(), library.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_oracle(spark, duck, plain, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_every_other_query_has_an_expectation_of_its_own():
    told = (Path(__file__).parent / "test_expected.py").read_text()
    for name in set(QUERIES) - set(ORACLES):
        assert f'"{name}"' in told, name


@pytest.mark.parametrize("name", ["b1_regime_from_elements", "c2_active_leo", "d2_asof_join", "d8_orbital_bins", "d9_near_pairs", "d10_closest_approach", "e3_dashboard", "w1_latest_per_key"])
def test_plans_have_no_python_and_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
