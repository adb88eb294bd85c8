"""What plots of interval clusterings are drawn from, as DataFrames. Rendering is up to the client."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.operators.frame import IntervalFrame, quoted
from spanforge.sources.readers import uniform


def feature_names(names: Sequence[str] | None, n: int) -> list[str]:
    """Given names, padded with Feature_i (from 1)."""
    names = list(names or [])
    return names + [f"Feature_{i + 1}" for i in range(len(names), n)]


def clusters(frame: IntervalFrame | None, label: str | None = None, centroids: DataFrame | None = None) -> list[int]:
    """Sorted labels; 0 without labels; 0..k-1 with centroids alone."""
    if frame is not None:
        return [0] if label is None else [r[0] for r in frame.df.select(quoted(label).cast("int")).distinct().orderBy(quoted(label).cast("int")).collect()]
    if centroids is None:
        raise ValueError("intervals or centroids are needed")
    return list(range(centroids.count()))


def feature_bounds(frame: IntervalFrame, centroids: DataFrame | None = None, margin: float = 0.1) -> DataFrame:
    """(feature, low, high): the range over data and centroids, widened by ``margin`` of it."""
    rows = frame.long().select("feature", "lower", "upper")
    if centroids is not None:
        rows = rows.unionByName(IntervalFrame(centroids).long().select("feature", "lower", "upper"))
    low, high = F.min("lower"), F.max("upper")
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return rows.groupBy("feature").agg((low - margin * span).alias("low"), (high + margin * span).alias("high"))


def scale_to_unit(value: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(0.5)).otherwise((value - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))


def sample_per_cluster(frame: IntervalFrame, label: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each cluster, drawn by a hash of the key."""
    key = quoted(frame.require_key())
    order = W.partitionBy(quoted(label)).orderBy(uniform(key, seed), key)
    return frame.df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def rectangles(frame: IntervalFrame, label: str | None = None) -> DataFrame:
    """The first two features; a single feature makes squares."""
    key = quoted(frame.require_key()).alias("row_id")
    b = frame.bounds()
    (xl, xu), (yl, yu) = b[0], b[1] if len(b) > 1 else b[0]
    cluster = quoted(label).cast("int") if label else F.lit(0)
    return frame.df.select(key, cluster.alias("cluster"), xl.alias("x"), yl.alias("y"), (xu - xl).alias("width"), (yu - yl).alias("height"))


#: Corners (x, y, z as 0 lower / 1 upper) of the six faces.
FACES = (
    ((0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1)),
    ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)),
    ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)),
    ((0, 1, 0), (1, 1, 0), (1, 1, 1), (0, 1, 1)),
    ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)),
    ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)),
)


def cuboid_faces(frame: IntervalFrame) -> DataFrame:
    """(row_id, face, corner, x, y, z) of the first three features."""
    if frame.n_features < 3:
        raise ValueError("cuboids need three features")
    b = frame.bounds()
    corners = [F.struct(F.lit(f).alias("face"), F.lit(c).alias("corner"), *(b[d][at].alias(n) for d, (n, at) in enumerate(zip("xyz", corner)))) for f, face in enumerate(FACES) for c, corner in enumerate(face)]
    return frame.df.select(quoted(frame.require_key()).alias("row_id"), F.inline(F.array(*corners)))


def axis_limits(frame: IntervalFrame, dims: int = 2, margin: float = 0.1) -> DataFrame:
    return frame.long().where(F.col("dim") < dims).groupBy("dim").agg((F.min("lower") - margin).alias("low"), (F.max("upper") + margin).alias("high"))


def cluster_listing(frame: IntervalFrame, label: str, sort_by: str | None = "lower", order: Sequence[int] | None = None) -> DataFrame:
    """(cluster, place, cluster_size, feature, position, lower, upper): intervals listed within cluster and feature.

    sort_by: lower, upper, width, or None for the order of the key. ``order`` must name every cluster.
    """
    known = clusters(frame, label)
    if order is not None and set(order) != set(known):
        raise ValueError(f"the order must name the clusters {known}")
    by = {"lower": F.col("lower"), "upper": F.col("upper"), "width": F.col("upper") - F.col("lower"), None: F.col("row_id")}
    if sort_by not in by:
        raise ValueError(f"unknown order {sort_by!r}")
    key = frame.require_key()
    rows = frame.long().select(quoted(key).alias("row_id"), "feature", "lower", "upper").join(frame.df.select(quoted(key).alias("row_id"), quoted(label).cast("int").alias("cluster")), "row_id")
    place = F.create_map(*(F.lit(x) for i, c in enumerate(order or known) for x in (c, i)))
    group = W.partitionBy("cluster", "feature")
    return rows.select(
        "cluster", place[F.col("cluster")].alias("place"), F.count(F.lit(1)).over(group).alias("cluster_size"), "feature", F.row_number().over(group.orderBy(by[sort_by], "row_id")).alias("position"), "row_id", "lower", "upper"
    )


def _with_ranges(frame: IntervalFrame) -> DataFrame:
    """The long rows with their feature's smallest lower and largest upper bound: one row a feature is broadcast."""
    rows = frame.long()
    return rows.join(F.broadcast(rows.groupBy("dim").agg(F.min("lower").alias("_low"), F.max("upper").alias("_high"))), "dim")


def parallel_centres(frame: IntervalFrame) -> DataFrame:
    """(row_id, dim, y): midpoints scaled to the feature's range."""
    rows = _with_ranges(frame).withColumn("mid", (F.col("lower") + F.col("upper")) / 2)
    return rows.select(quoted(frame.require_key()).alias("row_id"), "dim", scale_to_unit(F.col("mid"), F.col("_low"), F.col("_high")).alias("y"))


def bundling(frame: IntervalFrame, label: str) -> DataFrame:
    """(segment, cluster, y): per pair of neighbouring axes the clusters, ranked by mean midpoint and spread evenly over [0.1, 0.9]."""
    key = frame.require_key()
    y = parallel_centres(frame).join(frame.df.select(quoted(key).alias("row_id"), quoted(label).cast("int").alias("cluster")), "row_id")
    nxt = y.select("row_id", (F.col("dim") - 1).alias("dim"), F.col("y").alias("y2"))
    mean = y.join(nxt, ["row_id", "dim"]).groupBy(F.col("dim").alias("segment"), "cluster").agg(F.avg((F.col("y") + F.col("y2")) / 2).alias("m"))
    rank = F.row_number().over(W.partitionBy("segment").orderBy("m", "cluster"))
    n = F.count(F.lit(1)).over(W.partitionBy("segment"))
    return mean.select("segment", "cluster", F.when(n > 1, 0.1 + 0.8 * (rank - 1) / F.when(n > 1, n - 1).otherwise(F.lit(1))).otherwise(F.lit(0.1)).alias("y"))


def bezier(segments: DataFrame, beta: float = 0.8, alpha: float = 1 / 6, points: int = 50) -> DataFrame:
    """Points of two joined cubics from (x0, y0) through the bundled midpoint to (x1, y1).

    segments: id, x0, y0, x1, y1, target. The midpoint is pulled to ``target`` by ``beta``.
    """
    c = F.col
    mx, my = (c("x0") + c("x1")) / 2, (1 - beta) * (c("y0") + c("y1")) / 2 + beta * c("target")
    run = (c("x1") - c("x0")) * alpha
    t = c("_i") / F.lit(float(points - 1))
    half = segments.withColumns({"_mx": mx, "_my": my, "_run": run}).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"), F.lit(None).alias("_")).drop("_")
    sides = half.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    left = c("half") == 0
    p0x, p0y = F.when(left, c("x0")).otherwise(c("_mx")), F.when(left, c("y0")).otherwise(c("_my"))
    p3x, p3y = F.when(left, c("_mx")).otherwise(c("x1")), F.when(left, c("_my")).otherwise(c("y1"))
    cubic = lambda a, b, d, e: F.pow(1 - t, 3) * a + 3 * F.pow(1 - t, 2) * t * b + 3 * (1 - t) * t * t * d + F.pow(t, 3) * e
    return sides.select("id", "half", c("_i").alias("point"), cubic(p0x, p0x + c("_run"), p3x - c("_run"), p3x).alias("x"), cubic(p0y, p0y, p3y, p3y).alias("y"))


def radar(frame: IntervalFrame) -> DataFrame:
    """(row_id, step, feature, angle, lower, upper) scaled to the unit range; the first point closes the polygon."""
    d = frame.n_features
    rows, low, high = _with_ranges(frame), F.col("_low"), F.col("_high")
    unit = rows.select(quoted(frame.require_key()).alias("row_id"), F.col("dim").alias("step"), "feature", (F.col("dim") * (2 * math.pi / d)).alias("angle"), scale_to_unit(F.col("lower"), low, high).alias("lower"), scale_to_unit(F.col("upper"), low, high).alias("upper"))
    return unit.unionByName(unit.where("step = 0").withColumn("step", F.lit(d)))


def heat_map(matrix: DataFrame, columns: Sequence | None = None) -> DataFrame:
    """A long (i, j, value) matrix as a wide one."""
    return matrix.groupBy("i").pivot("j", list(columns) if columns is not None else None).agg(F.first("value"))
