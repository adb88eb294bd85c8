"""Pair matrices as long tables (i, j, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import metrics
from spanforge.operators.frame import IntervalFrame, quoted

#: Rows a side may have to be broadcast to a nested-loop join; larger ones are joined in blocks, of which there are some at least.
BROADCAST_ROWS, BLOCK_ROWS, LEAST_BLOCKS = 20_000, 5_000, 32
#: Pairs a task of a nested-loop join compares.
TASK_PAIRS = 4_000_000


def _side(frame: IntervalFrame, prefix: str, *others: Column) -> DataFrame:
    key = frame.require_key()
    return frame.df.select(quoted(key).alias(f"{prefix}_id"), *others, *(c.alias(f"{prefix}{n}_{s}") for n, pair in enumerate(frame.bounds()) for s, c in zip(("lo", "up"), pair)))


def _bounds(prefix: str, n: int) -> list[tuple[Column, Column]]:
    return [(F.col(f"{prefix}{i}_lo"), F.col(f"{prefix}{i}_up")) for i in range(n)]


def joined(a: DataFrame, b: DataFrame, condition: Column | None, n_a: int, n_b: int) -> DataFrame:
    """All pairs of rows, without broadcasting a side of unchecked size; the tasks are as many as the pairs need.

    Beyond ``BROADCAST_ROWS`` the rows are dealt into blocks and the blocks'
    pairs are an equi-join whose tasks hold a few blocks each. Rows repeat once a
    block, so their estimated size says nothing and the join is named.
    """
    if n_b <= BROADCAST_ROWS:
        tasks = -(-n_a * n_b // TASK_PAIRS)
        dealt = a.repartition(tasks, "a_id") if tasks > 1 else a
        return dealt.join(F.broadcast(b), condition if condition is not None else F.lit(True))
    blocks = max(LEAST_BLOCKS, -(-max(n_a, n_b) // BLOCK_ROWS))
    tasks = blocks * blocks // 4
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = a.withColumn("_x", block("a_id")).withColumn("_y", every).repartition(tasks, "_x", "_y")
    right = b.withColumn("_y", block("b_id")).withColumn("_x", every).repartition(tasks, "_x", "_y")
    both = left.join(right.hint("shuffle_hash"), ["_x", "_y"]).drop("_x", "_y")
    return both.where(condition) if condition is not None else both


def upper(frame: IntervalFrame, metric="hausdorff", eps: bool = False, distance: bool | None = None) -> DataFrame:
    """(i, j, value) for i < j. distance=True turns a similarity into 1 - s."""
    f, similar = metrics.resolve(metric)
    if distance and similar:
        f = metrics.similarity_to_distance(f)
    n = frame.n_features
    both = joined(_side(frame, "a"), _side(frame, "b"), F.col("a_id") < F.col("b_id"), frame.n_samples, frame.n_samples)
    return both.select(F.col("a_id").alias("i"), F.col("b_id").alias("j"), f(_bounds("a", n), _bounds("b", n), eps=eps).alias("value"))


def condensed(frame: IntervalFrame, metric="euclidean") -> DataFrame:
    """The upper triangle that clustering uses: batch distances, 1 - s for similarities."""
    return upper(frame, metric, eps=True, distance=True)


def _square(frame: IntervalFrame, metric, diagonal: float) -> DataFrame:
    half = upper(frame, metric)
    key = quoted(frame.require_key())
    both = half.select(F.explode(F.array(F.struct("i", "j", "value"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("value")))).alias("p")).select("p.*")
    return both.unionByName(frame.df.select(key.alias("i"), key.alias("j"), F.lit(diagonal).alias("value")))


def pairwise_distance(frame: IntervalFrame, metric: str = "hausdorff") -> DataFrame:
    if metric not in metrics.DISTANCES:
        raise ValueError(f"unknown distance {metric!r}; known: {sorted(metrics.DISTANCES)}")
    return _square(frame, metric, 0.0)


def pairwise_similarity(frame: IntervalFrame, metric: str = "jaccard") -> DataFrame:
    if metric not in metrics.SIMILARITIES:
        raise ValueError(f"unknown similarity {metric!r}; known: {sorted(metrics.SIMILARITIES)}")
    return _square(frame, metric, 1.0)


def _cross(a: IntervalFrame, b: IntervalFrame, f) -> DataFrame:
    if a.n_features != b.n_features:
        raise ValueError("both sides need the same number of features")
    n = a.n_features
    both = joined(_side(a, "a"), _side(b, "b"), None, a.n_samples, b.n_samples)
    return both.select(F.col("a_id").alias("i"), F.col("b_id").alias("j"), f(_bounds("a", n), _bounds("b", n)).alias("value"))


def cross_distance(a: IntervalFrame, b: IntervalFrame, metric: str = "hausdorff") -> DataFrame:
    if metric not in metrics.DISTANCES:
        raise ValueError(f"unknown distance {metric!r}; known: {sorted(metrics.DISTANCES)}")
    return _cross(a, b, metrics.DISTANCES[metric])


def cross_similarity(a: IntervalFrame, b: IntervalFrame, metric: str = "jaccard") -> DataFrame:
    if metric not in metrics.SIMILARITIES:
        raise ValueError(f"unknown similarity {metric!r}; known: {sorted(metrics.SIMILARITIES)}")
    return _cross(a, b, metrics.SIMILARITIES[metric])
