from collections import Counter

import pytest

from tessella.plans.oracle import ORACLES
from tessella.plans.queries import FOUND


def same(df, want):
    cols, rows = want
    order = sorted(cols)
    assert sorted(df.columns) == order
    pick = lambda names, r: tuple(repr(r[list(names).index(c)]) for c in order)
    assert Counter(pick(df.columns, tuple(r)) for r in df.collect()) == Counter(pick(cols, r) for r in rows)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_query_matches_duckdb(spark, duck, name):
    if name in ORACLES:
        same(FOUND[name](spark, "/root/testdata/sf0.001"), duck(ORACLES[name]))
    else:
        assert FOUND[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 6
