import math

import pytest
from pyspark.sql import functions as F

from spanforge.functions import metrics
from spanforge.operators import pairs
from tests.helpers import cells, frame


def value(spark, name, a, b, eps=False):
    f, _ = metrics.resolve(name)
    side = lambda rows: [(F.lit(float(lo)), F.lit(float(up))) for lo, up in rows]
    return spark.range(1).select(f(side(a), side(b), eps=eps).alias("v")).first().v


@pytest.mark.parametrize(
    "dims,hausdorff,squares,manhattan", [(1, 2, 5, 3), (2, 4, 10, 6), (3, 6, 15, 9)]
)
def test_distances(spark, dims, hausdorff, squares, manhattan):
    a, b = [[1, 5], [2, 6], [3, 7]][:dims], [[2, 7], [3, 8], [4, 9]][:dims]
    assert value(spark, "hausdorff", a, b) == hausdorff
    assert value(spark, "euclidean", a, b) == pytest.approx(math.sqrt(squares))
    assert value(spark, "euclidean_optimized", a, b) == pytest.approx(math.sqrt(squares))
    assert value(spark, "manhattan", a, b) == manhattan
    assert value(spark, "chebyshev", a, b) == 2


@pytest.mark.parametrize(
    "a,b,expected",
    [
        ([1, 5], [1, 5], (1, 1, 1, 1, 1)),
        ([1, 5], [3, 7], (1 / 3, 0.5, 0.5, 0.25, 0.5 * (1 / 3 + 1))),
        ([1, 3], [4, 6], (0, 0, 0, 0, 0.4)),
        ([1, 10], [3, 5], (2 / 9, 4 / 11, 2 / 9, 2 / 9, 0.5 * (2 / 9 + 1))),
        ([1, 3], [3, 5], (0, 0, 0, 0, 0.5)),
        ([3, 3], [1, 5], (0, 0, 0, 0, 0.5)),
        ([3, 3], [3, 3], (0, 0, 0, 0, 0)),
    ],
)
def test_similarities(spark, a, b, expected):
    for name, want in zip(("jaccard", "dice", "bidirectional_min", "bidirectional_prod", "hedjazi"), expected):
        assert value(spark, name, [a], [b]) == pytest.approx(want), name
        assert value(spark, name, [b], [a]) == pytest.approx(want), name


def test_edges(spark):
    assert value(spark, "euclidean", [[1, 2]], [[1, 2]]) == 0
    assert value(spark, "euclidean", [[1, 2]], [[1, 2]], eps=True) == pytest.approx(1e-8)
    assert value(spark, "cosine", [[0, 0]], [[1, 2]]) == 1.0
    nulls = frame(spark, [[[1, None]], [[2, 3]]])
    assert [r.value for r in pairs.upper(nulls, "hausdorff").collect()] == [None]
    with pytest.raises(ValueError):
        metrics.resolve("nope")
    with pytest.raises(ValueError):
        metrics.resolve(lambda a: a)


def test_custom_metrics(spark):
    f = frame(spark, [[[1, 5]], [[2, 7]]])
    assert pairs.upper(f, lambda a, b: F.abs(a[0][0] - b[0][0])).first().value == 1
    python = metrics.pandas_metric(lambda a, b: abs(a[0][1] - b[0][1]))
    assert pairs.upper(f, python).first().value == 2


def test_conversions(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (9.0,)], "x double")
    assert [r[0] for r in df.select(metrics.dist_to_sim(F.col("x"))).collect()] == pytest.approx([1, 0.5, 0.25, 0.1])
    assert [r[0] for r in df.limit(2).select(metrics.sim_to_dist(F.col("x"))).collect()] == [1, 0]
    with pytest.raises(ValueError):
        metrics.sim_to_dist(F.col("x"), "other")


def test_matrices(spark):
    a = frame(spark, [[[1, 3]], [[2, 4]], [[5, 7]]])
    sim = {(r.i, r.j): r.value for r in pairs.pairwise_similarity(a, "jaccard").collect()}
    assert sim[0, 1] == pytest.approx(1 / 3) and sim[1, 0] == sim[0, 1] and sim[0, 2] == 0 and sim[2, 2] == 1
    dist = {(r.i, r.j): r.value for r in pairs.pairwise_distance(a, "hausdorff").collect()}
    assert dist[0, 1] == 1 and dist[0, 2] == 4 and dist[1, 1] == 0 and len(dist) == 9
    cross = {(r.i, r.j): r.value for r in pairs.cross_distance(a, a, "hausdorff").collect()}
    assert cross == dist
    with pytest.raises(ValueError):
        pairs.pairwise_distance(a, "jaccard")
    with pytest.raises(ValueError):
        pairs.pairwise_similarity(a, "hausdorff")


def test_blocks_equal_broadcast(spark, monkeypatch):
    a = frame(spark, [[[i, i + 2]] for i in range(30)])
    whole = sorted(map(tuple, pairs.upper(a, "manhattan").collect()))
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, pairs.upper(a, "manhattan").collect())) == whole


def test_cells_helper(spark):
    assert cells(frame(spark, [[[1, 2]]]).df) == [(1.0, 2.0)]
