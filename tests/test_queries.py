"""Every query with SQL beside it, over the smallest tables; the rest must run."""

import math

import pytest

from karst.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"knn_approx", "knn_search", "fit_embedding", "fit_embedding_outliers", "hub_reach_k3"}  # have tests of their own


def plain(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = plain(df.select(*sorted(df.columns)).collect())
    assert rows
    if name in ORACLES:
        assert rows == plain(duck(SF, ORACLES[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
