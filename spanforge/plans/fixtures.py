"""Interval views over the driver's tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.operators.frame import IntervalFrame

QUARTILES = {
    "iv_supplier": ("lineitem", "l_suppkey", (("qty", "l_quantity"), ("price", "l_extendedprice"), ("disc", "l_discount"))),
    "iv_nation": ("customer", "c_nationkey", (("bal", "c_acctbal"), ("key", "c_custkey"))),
    "iv_user": ("events", "user_id", (("val", "value"), ("evt", "event_id"))),
}
PART = (("qty", "l_quantity"), ("price", "l_extendedprice"), ("disc", "l_discount"))


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quartiles(spark, sf_dir, view: str) -> IntervalFrame:
    """Exact first and third quartiles per group; one shuffle on the group, each column sorted once within it.

    Equal to quantile_cont to the last bit, since near ties are ordered by it: lower * (1 - part) + upper * part,
    the first product and the sum rounded once together. Halves and quarters are exact, so only 3/4 of a lower
    neighbour (part = 1/4) is rounded; its error and the sum's are known exactly and added last.
    """
    table, key, columns = QUARTILES[view]
    df = _table(spark, sf_dir, table).groupBy(F.col(key).cast("long").alias("row_id")).agg(*(F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(n) for n, c in columns))
    bounds = {f"{n}_{s}": (n, q) for n, _ in columns for s, q in (("lower", 0.25), ("upper", 0.75))}
    # In steps: later ones name a value several times.
    for step in (
        lambda b, n, q: {f"{b}_at": (F.size(n) - 1) * F.lit(q)},
        lambda b, n, q: {f"{b}_i": F.floor(f"{b}_at").cast("int")},
        lambda b, n, q: {f"{b}_x": F.get(n, F.col(f"{b}_i")), f"{b}_y": F.get(n, F.ceil(f"{b}_at").cast("int")), f"{b}_part": F.col(f"{b}_at") - F.col(f"{b}_i")},
        lambda b, n, q: {f"{b}_p": F.col(f"{b}_x") * (1 - F.col(f"{b}_part")), f"{b}_c": F.col(f"{b}_y") * F.col(f"{b}_part")},
        lambda b, n, q: {f"{b}_s": F.col(f"{b}_p") + F.col(f"{b}_c")},
        lambda b, n, q: {b: F.when(F.col(f"{b}_part") == 0, F.col(f"{b}_x")).when((F.col(f"{b}_part") == 0.25) & (F.abs(f"{b}_s") < float("inf")), F.col(f"{b}_s") + _lost(b)).otherwise(F.col(f"{b}_s"))},
    ):
        df = df.withColumns({k: v for b, (n, q) in bounds.items() for k, v in step(b, n, q).items()})
    return IntervalFrame(df.select("row_id", *bounds), "row_id")


def _lost(b: str) -> Column:
    """What rounding took from p = x / 2 + x / 4 and from s = p + c."""
    x, p, c, s = (F.col(f"{b}_{k}") for k in "xpcs")
    return (x * 0.25 - (p - x * 0.5)) + ((p - (s - (s - p))) + (c - (s - p)))


def part(spark, sf_dir) -> IntervalFrame:
    aggs = [f(F.col(c)).alias(f"{n}_{s}") for n, c in PART for s, f in (("lower", F.min), ("upper", F.max))]
    return IntervalFrame(_table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row_id")).agg(*aggs), "row_id")


def dirty(spark, sf_dir) -> IntervalFrame:
    """The part intervals, damaged by row id: some inverted, some with missing bounds."""
    at = lambda k: F.col("row_id") % k == 0
    c = F.col
    return IntervalFrame(
        part(spark, sf_dir).df.select(
            "row_id",
            F.when(at(7), c("qty_upper")).otherwise(c("qty_lower")).alias("qty_lower"),
            F.when(at(7), c("qty_lower")).otherwise(c("qty_upper")).alias("qty_upper"),
            F.when(~at(11), c("price_lower")).alias("price_lower"),
            F.when(~at(13), c("price_upper")).alias("price_upper"),
            F.when(~at(17), c("disc_lower")).alias("disc_lower"),
            F.when(~at(17), c("disc_upper")).alias("disc_upper"),
        ),
        "row_id",
    )


def sql_views() -> dict[str, str]:
    """name -> select, for a WITH clause."""
    out = {}
    for view, (table, key, columns) in QUARTILES.items():
        cols = ", ".join(f"quantile_cont({c}::double, {q}) as {n}_{s}" for n, c in columns for s, q in (("lower", 0.25), ("upper", 0.75)))
        out[view] = f"select {key}::bigint as row_id, {cols} from {table} group by {key}"
    cols = ", ".join(f"{f}({c}) as {n}_{s}" for n, c in PART for s, f in (("lower", "min"), ("upper", "max")))
    out["iv_part"] = f"select l_partkey as row_id, {cols} from lineitem group by l_partkey"
    out["iv_dirty"] = (
        "select row_id, case when row_id % 7 = 0 then qty_upper else qty_lower end as qty_lower, case when row_id % 7 = 0 then qty_lower else qty_upper end as qty_upper, "
        "case when row_id % 11 <> 0 then price_lower end as price_lower, case when row_id % 13 <> 0 then price_upper end as price_upper, "
        "case when row_id % 17 <> 0 then disc_lower end as disc_lower, case when row_id % 17 <> 0 then disc_upper end as disc_upper from iv_part"
    )
    return out


FEATURES = {"iv_supplier": ("qty", "price", "disc"), "iv_nation": ("bal", "key"), "iv_user": ("val", "evt"), "iv_part": ("qty", "price", "disc"), "iv_dirty": ("qty", "price", "disc")}
#: Row ids start at 0 and 1 alike, so the k smallest ids serve as initial centroids.
K_SERIES = ((2, 100.0), (3, 60.0), (4, 30.0), (5, 25.0), (6, 22.0), (7, 20.0), (8, 19.0), (9, 18.5), (10, 18.0))
