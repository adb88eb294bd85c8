"""Cluster validity indices over rows with an integer label column."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import metrics
from spanforge.operators import pairs
from spanforge.operators.frame import IntervalFrame, quoted

SMALL = 1e-15


def _flat(frame: IntervalFrame, label: str) -> DataFrame:
    """a0_lo, a0_up, ... and ``label``."""
    return frame.df.select(quoted(label).cast("int").alias("label"), *(c.alias(f"a{i}_{s}") for i, pair in enumerate(frame.bounds()) for s, c in zip(("lo", "up"), pair)))


def _centres(frame: IntervalFrame, centers: DataFrame, position: bool) -> DataFrame:
    """label, b0_lo, ...; by position: the i-th centre belongs to the i-th label in order."""
    cols = [quoted(c).alias(f"b{i}_{s}") for i, (_, lo, up) in enumerate(frame.pairs) for s, c in (("lo", lo), ("up", up))]
    number = F.row_number().over(W.orderBy("cluster")) if position else F.col("cluster")
    return centers.select(number.cast("int").alias("c"), *cols)


def _to_own_centre(frame: IntervalFrame, label: str, centers: DataFrame, metric, position: bool) -> DataFrame:
    """(label, d) of every row; rows without a centre have no d.

    Whether centres are broadcast is left to their size as Spark measures it.
    """
    rows, own = _flat(frame, label), _centres(frame, centers, position)
    if position:
        names = rows.select("label").distinct().withColumn("c", F.row_number().over(W.orderBy("label")))
        rows = rows.join(names, "label")
    else:
        rows = rows.withColumn("c", F.col("label"))
    n = frame.n_features
    return rows.join(own, "c", "left").select("label", metric(pairs._bounds("a", n), pairs._bounds("b", n), eps=True).alias("d"))


def distortion_frame(frame: IntervalFrame, label: str, centers: DataFrame, metric="euclidean") -> DataFrame:
    """Mean squared distance to the centre of the label; labels without one count as rows only."""
    d = _to_own_centre(frame, label, centers, metrics.as_distance(metric), position=False)
    return d.agg(F.when(F.count(F.lit(1)) > 0, F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).otherwise(0.0).alias("value"))


def _pair_rows(frame: IntervalFrame, label: str, metric, ordered: bool = True) -> DataFrame:
    """(i, j, li, lj, d) for i < j, or for i != j; d compares the row with the smaller key to the other."""
    n = frame.n_features
    of = lambda name: quoted(label).cast("int").alias(name)
    i, j = F.col("a_id"), F.col("b_id")
    both = pairs.joined(pairs._side(frame, "a", of("li")), pairs._side(frame, "b", of("lj")), i < j if ordered else i != j, frame.n_samples, frame.n_samples)
    a, b = pairs._bounds("a", n), pairs._bounds("b", n)
    if not ordered and callable(metric):  # the others give the same value both ways
        pick = lambda p, q: [tuple(F.when(i < j, x).otherwise(y) for x, y in zip(*both)) for both in zip(p, q)]
        a, b = pick(a, b), pick(b, a)
    return both.select(i.alias("i"), j.alias("j"), "li", "lj", metrics.as_distance(metric)(a, b, eps=True).alias("d"))


def silhouette_rows(frame: IntervalFrame, label: str, metric="euclidean") -> DataFrame:
    """(i, a, b, s) per row. a leaves out zero distances; a row alone in its cluster has a = 0."""
    counted = F.when((F.col("li") != F.col("lj")) | (F.col("d") > 0), F.col("d"))
    per = _pair_rows(frame, label, metric, ordered=False).groupBy("i", "li", F.col("lj").alias("to")).agg(F.avg(counted).alias("mean"))
    own = F.max(F.when(F.col("li") == F.col("to"), F.col("mean")))
    other = F.min(F.when(F.col("li") != F.col("to"), F.col("mean")))
    ab = per.groupBy("i").agg(F.coalesce(own, F.lit(0.0)).alias("a"), F.coalesce(other, F.lit(0.0)).alias("b"))
    top = F.greatest("a", "b")
    return ab.withColumn("s", F.when(top > SMALL, (F.col("b") - F.col("a")) / F.when(top > SMALL, top).otherwise(F.lit(1.0))).otherwise(0.0))


def silhouette_frame(frame: IntervalFrame, label: str, metric="euclidean") -> DataFrame:
    clusters = frame.df.agg(F.countDistinct(quoted(label))).first()[0]
    if clusters <= 1 or frame.n_samples <= 1:
        return frame.df.sparkSession.createDataFrame([(0.0,)], "value double")
    return silhouette_rows(frame, label, metric).agg(F.avg("s").alias("value"))


def calinski_harabasz_frame(frame: IntervalFrame, label: str, centers: DataFrame, metric="euclidean") -> DataFrame:
    f = metrics.as_distance(metric)
    n_f = frame.n_features
    d = _to_own_centre(frame, label, centers, f, position=True)
    within = d.agg(F.sum(F.col("d") * F.col("d")).alias("w"), F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k"))
    sizes = _flat(frame, label).groupBy("label").agg(F.count(F.lit(1)).alias("size")).withColumn("c", F.row_number().over(W.orderBy("label")))
    whole = frame.df.agg(*(F.avg(c).alias(f"a{i}_{s}") for i, pair in enumerate(frame.bounds()) for s, c in zip(("lo", "up"), pair)))
    spread = _centres(frame, centers, True).join(sizes, "c").join(F.broadcast(whole), F.lit(True))
    dist = f(pairs._bounds("b", n_f), pairs._bounds("a", n_f), eps=True)
    between = spread.agg(F.sum(F.col("size") * dist * dist).alias("b"))
    one = within.join(F.broadcast(between), F.lit(True))
    none = (F.col("k") < 2) | (F.col("n") == F.col("k"))
    flat = F.abs("w") < SMALL
    safe = lambda c: F.when(none | flat, F.lit(1.0)).otherwise(c)
    value = (F.col("b") / safe(F.col("k") - 1)) / safe(F.col("w") / F.when(none, F.lit(1.0)).otherwise(F.col("n") - F.col("k")))
    return one.select(F.when(none, 0.0).when(flat, F.when(F.col("b") == 0, 0.0).otherwise(float("inf"))).otherwise(value).alias("value"))


def davies_bouldin_frame(frame: IntervalFrame, label: str, centers: DataFrame, metric="euclidean") -> DataFrame:
    f = metrics.as_distance(metric)
    n_f = frame.n_features
    s = _to_own_centre(frame, label, centers, f, position=True).groupBy("label").agg(F.avg("d").alias("s")).withColumn("c", F.row_number().over(W.orderBy("label")))
    c = _centres(frame, centers, True).join(s.select("c", "s"), "c")
    left = c.select(F.col("c").alias("ci"), F.col("s").alias("si"), *(F.col(f"b{i}_{x}").alias(f"a{i}_{x}") for i in range(n_f) for x in ("lo", "up")))
    right = c.select(F.col("c").alias("cj"), F.col("s").alias("sj"), *(f"b{i}_{x}" for i in range(n_f) for x in ("lo", "up")))
    both = left.join(right, F.col("ci") != F.col("cj")).withColumn("d", f(pairs._bounds("a", n_f), pairs._bounds("b", n_f), eps=True))
    worst = both.where(F.abs("d") >= SMALL).groupBy("ci").agg(F.max((F.col("si") + F.col("sj")) / F.when(F.abs("d") >= SMALL, F.col("d")).otherwise(F.lit(1.0))).alias("r"))
    return worst.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("value"))


def dunn_frame(frame: IntervalFrame, label: str, metric="euclidean") -> DataFrame:
    d = _pair_rows(frame, label, metric)
    apart = F.min(F.when(F.col("li") != F.col("lj"), F.col("d")))
    wide = F.coalesce(F.max(F.when(F.col("li") == F.col("lj"), F.col("d"))), F.lit(0.0))
    got = d.agg(apart.alias("apart"), wide.alias("wide"))
    flat = F.col("wide") < SMALL
    ratio = F.col("apart") / F.when(flat, F.lit(1.0)).otherwise(F.col("wide"))
    return got.select(F.when(F.col("apart").isNull(), 0.0).when(flat, F.when(F.col("apart") > 0, float("inf")).otherwise(0.0)).otherwise(ratio).alias("value"))


def _value(df: DataFrame) -> float:
    return float(df.first()["value"])


EVALUATION: dict[str, Callable[..., float]] = {
    "distortion": lambda frame, label, centers, metric: _value(distortion_frame(frame, label, centers, metric)),
    "silhouette": lambda frame, label, centers, metric: _value(silhouette_frame(frame, label, metric)),
    "calinski_harabasz": lambda frame, label, centers, metric: _value(calinski_harabasz_frame(frame, label, centers, metric)),
    "davies_bouldin": lambda frame, label, centers, metric: _value(davies_bouldin_frame(frame, label, centers, metric)),
    "dunn": lambda frame, label, centers, metric: _value(dunn_frame(frame, label, metric)),
}
EVALUATION |= {"inertia": EVALUATION["distortion"], "ch_index": EVALUATION["calinski_harabasz"], "db_index": EVALUATION["davies_bouldin"]}
#: Whether more is better.
MAXIMIZE = {"distortion": False, "inertia": False, "silhouette": True, "calinski_harabasz": True, "ch_index": True, "davies_bouldin": False, "db_index": False, "dunn": True}
DESCRIPTIONS = {
    "distortion": "mean squared distance to the own centre",
    "inertia": "mean squared distance to the own centre",
    "silhouette": "how much closer a row is to its own cluster than to the next one",
    "calinski_harabasz": "dispersion between clusters over dispersion within them",
    "ch_index": "dispersion between clusters over dispersion within them",
    "davies_bouldin": "mean likeness of each cluster to the one most like it",
    "db_index": "mean likeness of each cluster to the one most like it",
    "dunn": "smallest gap between clusters over the widest cluster",
}


def evaluate(frame: IntervalFrame, label: str, centers: DataFrame, metric="euclidean", index: str = "silhouette") -> float:
    if index not in EVALUATION:
        raise ValueError(f"unknown index {index!r}; known: {sorted(EVALUATION)}")
    metrics.resolve(metric)
    return EVALUATION[index](frame, label, centers, metric)


def sweep(frame: IntervalFrame, ks: Iterable[int], names: Iterable[str], metric, cluster: Callable[[int], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(metric, k, value). A k whose clustering fails is left out with a message."""
    names = list(names)
    if unknown := [n for n in names if n not in EVALUATION]:
        raise ValueError(f"unknown indices {unknown}; known: {sorted(EVALUATION)}")
    rows = []
    for k in ks:
        try:
            labelled, centers = cluster(k)
            own = IntervalFrame(labelled, frame.key)
            rows += [(n, k, EVALUATION[n](own, "cluster", centers, metric)) for n in names]
        except ValueError as err:
            print(f"k = {k}: {err}")
    return frame.df.sparkSession.createDataFrame(rows, "metric string, k int, value double")
