"""Quartiles of the interval views against quantile_cont, to the last bit: near ties are ordered by it."""

import random


def test_quartiles_bits(spark, tmp_path):
    import duckdb

    from spanforge.plans.fixtures import quartiles, sql_views

    rng = random.Random(3)
    rows = [(k, float(rng.randint(1, 50)), rng.randint(90000, 10**7) / 100, rng.randint(0, 10) / 100) for k in range(1500) for _ in range(rng.randint(1, 12))]
    rows += [(1500, None, None, None), (1501, 1.0, float("inf"), 0.1), (1501, 2.0, float("inf"), 0.1)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(f"select * from ({sql_views()['iv_supplier']}) order by row_id").fetchall()
    assert [tuple(r) for r in quartiles(spark, str(tmp_path), "iv_supplier").df.orderBy("row_id").collect()] == want
