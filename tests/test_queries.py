"""Registered interval queries against their SQL, at the smallest scale."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "customer", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(df):
    cols = sorted(df.columns)
    plain = lambda x: None if x is None or x != x else round(float(x), 5) if not isinstance(x, (str, bool)) else str(x)
    return sorted(str([plain(x) for x in r]) for r in df[cols].astype(object).values)


@pytest.mark.parametrize("name", ["pair_hausdorff", "pair_hedjazi", "norm_zscore", "norm_robust", "fix_swap", "fill_mode", "impute_joint_mean", "lloyd_1", "fcm_membership", "silhouette", "davies_bouldin", "lmethod", "bundling", "csv_round_trip", "parquet_round_trip", "damage", "repaired", "indices", "params_midwidth", "custom_metric", "heat_map"])
def test_against_sql(spark, duck, name):
    from spanforge.plans import catalog

    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
