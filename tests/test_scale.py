"""What keeps queries bounded on larger tables: one reading of the facts, evenly dealt pairs, cheap rounding."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import evaluate, pairs
from tests.helpers import frame

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@data
@pytest.mark.parametrize("name", ["lloyd_3", "kmeans_summary", "silhouette", "pair_cosine", "fcm_membership"])
def test_quartiles_are_read_back(spark, name):
    """The groups' quartiles are computed once; what a query returns no longer reads the rows behind them."""
    from spanforge.plans import catalog

    files = catalog.queries()[name](spark, DATA).inputFiles()
    assert files and not any(x in f for f in files for x in ("lineitem", "events"))


@pytest.fixture
def blocks(monkeypatch):
    """Joins in blocks from eleven rows on."""
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(pairs, "LEAST_BLOCKS", 8)


def random_rows(n, seed=1):
    rng = random.Random(seed)
    return [[[x := rng.random(), x + rng.random()], [y := rng.random(), y + rng.random()]] for _ in range(n)]


def test_pairs_in_blocks_are_dealt_once(spark, blocks):
    """Tasks follow from the blocks, not from the session's number of partitions, and nothing deals the rows again."""
    rows = random_rows(40)
    got = pairs.upper(frame(spark, rows), "manhattan")
    assert got.rdd.getNumPartitions() == 8 * 8 // 4
    want = {(i, j): sum(abs(a - b) for p, q in zip(rows[i], rows[j]) for a, b in zip(p, q)) for j in range(40) for i in range(j)}
    assert {(r.i, r.j): r.value for r in got.collect()} == pytest.approx(want)


def test_pairs_of_a_broadcast_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TASK_PAIRS", 100)
    got = pairs.upper(frame(spark, random_rows(40)), "euclidean")
    assert got.rdd.getNumPartitions() == 16 and got.count() == 780


def test_rounding_is_of_half_away_from_zero(spark):
    """As F.round and as the SQL engine."""
    import duckdb

    from spanforge.plans.catalog import to_digits

    rng = random.Random(5)
    x = [s * v for s in (1, -1) for v in (0.0, 0.0078125, 0.0234375, 2.5e-7, 5e-7, 0.5, 1e9 / 3, 2.0**33 + 0.5, 1e300, math.inf, *(rng.random() * 10 ** rng.randint(-7, 5) for _ in range(500)))]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [tuple(r) for r in df.select(to_digits(F.col("x"), 6), F.round("x", 6)).collect()]
    assert [a for a, _ in got] == [b for _, b in got]
    con = duckdb.connect()
    assert [a for a, _ in got] == [con.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in x]
    assert spark.range(1).select(to_digits(F.lit(None).cast("double"), 6)).first()[0] is None


@pytest.mark.parametrize("name", ["hausdorff", "cosine", "jaccard", "bidirectional_prod", "hedjazi"])
def test_missing_bounds_in_blocks(spark, blocks, name):
    rows = [[[0.0, 0.0], [0.0, 0.0]], *random_rows(11), [[None, 1.0], [0.0, 1.0]]]
    got = {(r.i, r.j): r.value for r in pairs.upper(frame(spark, rows), name).collect()}
    assert len(got) == 78 and all((v is None) == (12 in k) for k, v in got.items())


@pytest.mark.parametrize("n", [30, 5])
def test_silhouette_of_an_uneven_metric(spark, blocks, n):
    """A metric of a caller's own may differ by direction: the row with the smaller key is its first side."""
    rows = random_rows(n, 2)
    uneven = lambda a, b: F.abs(a[0][0] - b[0][1]) + F.abs(a[1][0] - b[1][1])
    f = frame(spark, rows)
    f = f.with_df(f.df.withColumn("cluster", (F.col("row_id") % 3).cast("int")))

    def d(i, j):
        p, q = rows[min(i, j)], rows[max(i, j)]
        return abs(p[0][0] - q[0][1]) + abs(p[1][0] - q[1][1])

    mean = lambda v: sum(v) / len(v) if v else None
    for r in evaluate.silhouette_rows(f, "cluster", uneven).collect():
        to = {c: mean([d(r.i, j) for j in range(n) if j % 3 == c and j != r.i]) for c in range(3)}
        a, b = to[r.i % 3] or 0.0, min(v for c, v in to.items() if c != r.i % 3)
        assert (r.a, r.b, r.s) == pytest.approx((a, b, (b - a) / max(a, b)))


def test_silhouette_rows_are_dealt_by_blocks(spark, blocks):
    """Each ordered pair once, in tasks that follow from the blocks."""
    f = frame(spark, random_rows(40, 3))
    f = f.with_df(f.df.withColumn("cluster", (F.col("row_id") % 3).cast("int")))
    got = evaluate._pair_rows(f, "cluster", "euclidean", ordered=False)
    assert got.rdd.getNumPartitions() == 16 and got.select("i", "j").distinct().count() == got.count() == 40 * 39
