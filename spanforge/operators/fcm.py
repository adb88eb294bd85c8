"""Interval fuzzy c-means, also with adaptive weights per cluster and feature.

Memberships are a function of centres and weights, so they are recomputed, not
stored; each iteration is one aggregate job (two with adaptive weights).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import metrics
from spanforge.operators.frame import IntervalFrame, quoted
from spanforge.operators.kmeans import centroid_frame, check_whole
from spanforge.sources.readers import uniform

TINY = 1e-16


def feature_distances(bounds, centres, metric, similar: bool) -> list[list[Column]]:
    """[cluster][feature]: the metric on single intervals, 1 - s for similarities."""
    one = lambda pair, c: metric([pair], [(F.lit(float(c[0])), F.lit(float(c[1])))], eps=False)
    return [[1 - one(pair, c) if similar else one(pair, c) for pair, c in zip(bounds, centre)] for centre in centres]


def memberships(d: list[list[Column]], weights: Sequence[Sequence[float]] | None, m: float) -> list[Column]:
    """u per cluster; a row at distance zero belongs wholly to the first such cluster."""
    whole = [metrics.total(x * F.lit(float(w)) for x, w in zip(row, weights[c])) if weights else metrics.total(row) for c, row in enumerate(d)]
    zero = F.lit(False)
    out = []
    any_zero = F.least(*whole) == 0 if len(whole) > 1 else whole[0] == 0
    for c, own in enumerate(whole):
        share = metrics.total(F.pow(own / (other + F.lit(TINY)), F.lit(2.0 / (m - 1))) for other in whole) + F.lit(TINY)
        hit = (own == 0) & ~zero
        out.append(F.when(any_zero, F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0) / F.when(any_zero, F.lit(1.0)).otherwise(share)))
        zero = zero | (own == 0)
    return out


def centre_sums(bounds, u: list[Column], m: float) -> list[Column]:
    flat = [c for pair in bounds for c in pair]
    return [x for c, uc in enumerate(u) for x in [F.sum(F.pow(uc, F.lit(m))).alias(f"w{c}"), *(F.sum(F.pow(uc, F.lit(m)) * v).alias(f"s{c}_{j}") for j, v in enumerate(flat))]]


def centres_from(row, clusters: int, features: int):
    return [[tuple(float(row[f"s{c}_{2 * j + k}"]) / (float(row[f"w{c}"]) + TINY) for k in (0, 1)) for j in range(features)] for c in range(clusters)]


def weight_sums(d, u, m: float) -> list[Column]:
    return [F.sum(F.pow(u[c], F.lit(m)) * x * x).alias(f"v{c}_{j}") for c, row in enumerate(d) for j, x in enumerate(row)]


def weights_from(row, clusters: int, features: int) -> list[list[float]]:
    """Geometric mean of a cluster's dispersions over each of them, within [1e-6, 1e6]."""
    out = []
    for c in range(clusters):
        logs = [math.log(float(row[f"v{c}_{j}"]) + TINY) for j in range(features)]
        mean = sum(logs) / features
        out.append([min(1e6, max(1e-6, math.exp(min(700.0, mean - x)))) for x in logs])
    return out


def objective(d, u, weights, m: float) -> Column:
    """Sum of u^m times the (weighted) squared distances."""
    k = lambda c, j: F.lit(float(weights[c][j])) if weights else F.lit(1.0)
    return F.sum(metrics.total(F.pow(u[c], F.lit(m)) * metrics.total(k(c, j) * x * x for j, x in enumerate(row)) for c, row in enumerate(d)))


class IntervalFuzzyCMeans:
    def __init__(self, n_clusters: int = 2, m: float = 2.0, max_iter: int = 100, tol: float = 1e-5, adaptive_weights: bool = False, distance_func="euclidean", is_similarity: bool | None = None, random_state: int | None = None):
        self.n_clusters, self.m, self.max_iter, self.tol = n_clusters, m, max_iter, tol
        self.adaptive_weights, self.distance_func, self.random_state = adaptive_weights, distance_func, random_state
        self.metric, self.similar = metrics.resolve(distance_func, bool(is_similarity))
        self.centers_, self.weights_, self.objective_ = None, None, None

    def initial(self, frame: IntervalFrame, n: int) -> list[Column]:
        """Uniform draws by row key; about n // C rows a cluster are boosted by half; rows add up to 1."""
        key = quoted(frame.require_key())
        seed = 0 if self.random_state is None else self.random_state
        boosted = 1 - (1 - 1 / max(n, 1)) ** (n // self.n_clusters)
        raw = [uniform(key, seed, c, "u") * F.when(uniform(key, seed, c, "boost") < boosted, 1.5).otherwise(1.0) for c in range(self.n_clusters)]
        whole = metrics.total(raw)
        return [x / whole for x in raw]

    def fit(self, frame: IntervalFrame, start: list[Column] | None = None) -> IntervalFuzzyCMeans:
        """``start``: first memberships, a column per cluster; drawn by the row key if left out."""
        n, d, k = check_whole(frame), frame.n_features, self.n_clusters
        bounds = frame.bounds()
        frame.df.persist()
        try:
            u = start or self.initial(frame, n)
            sums = frame.df.agg(*centre_sums(bounds, u, self.m)).first()
            before, weights = None, None
            for it in range(1, self.max_iter + 1):
                centres = centres_from(sums, k, d)
                dist = feature_distances(bounds, centres, self.metric, self.similar)
                if self.adaptive_weights:
                    weights = weights_from(frame.df.agg(*weight_sums(dist, u, self.m)).first(), k, d)
                new = memberships(dist, weights, self.m)
                change = [F.abs(a - b) for a, b in zip(new, u)]
                sums = frame.df.agg(
                    objective(dist, new, weights, self.m).alias("j"), F.max(F.greatest(*change) if len(change) > 1 else change[0]).alias("delta"), *centre_sums(bounds, new, self.m)
                ).first()
                u = new
                j = float(sums["j"])
                self.n_iter_ = it
                if sums["delta"] < self.tol or before is not None and (abs(j - before) < self.tol * abs(before) or it > 10 and abs(j - before) < 1e-8):
                    before = j
                    break
                before = j
        finally:
            frame.df.unpersist()
        self.centers_, self.weights_, self.objective_, self._fitted = centres, weights, before, frame
        return self

    def _ready(self) -> None:
        if self.centers_ is None:
            raise RuntimeError("fit first")

    def _u(self, frame: IntervalFrame) -> list[Column]:
        self._ready()
        return memberships(feature_distances(frame.bounds(), self.centers_, self.metric, self.similar), self.weights_, self.m)

    def predict(self, frame: IntervalFrame) -> DataFrame:
        """Adds ``u``, an array with one membership per cluster."""
        return frame.df.withColumn("u", F.array(*self._u(frame)))

    def predict_crisp(self, frame: IntervalFrame) -> DataFrame:
        """Adds ``cluster``; the first of equal memberships wins."""
        u = self._u(frame)
        ranked = [F.struct((-x).alias("d"), F.lit(i).alias("k")) for i, x in enumerate(u)]
        return frame.df.withColumn("cluster", (F.least(*ranked) if len(ranked) > 1 else ranked[0])["k"])

    def get_membership(self) -> DataFrame:
        self._ready()
        return self.predict(self._fitted)

    def get_crisp_assignments(self) -> DataFrame:
        self._ready()
        return self.predict_crisp(self._fitted)

    def get_centers(self) -> DataFrame:
        self._ready()
        return centroid_frame(self._fitted, self.centers_)

    def get_objective(self) -> float | None:
        return self.objective_

    def get_performance_stats(self) -> dict:
        self._ready()
        return {"n_iter": self.n_iter_, "objective": self.objective_, "n_clusters": self.n_clusters, "adaptive_weights": self.adaptive_weights}

    def cluster_and_return(self, frame: IntervalFrame, k: int, n_init: int = 1, max_iter: int | None = None) -> tuple[DataFrame, DataFrame]:
        seed = self.random_state or 0
        models = [IntervalFuzzyCMeans(k, self.m, max_iter or self.max_iter, self.tol, self.adaptive_weights, self.distance_func, self.similar, seed + i).fit(frame) for i in range(n_init)]
        best = min(models, key=lambda x: x.objective_)
        return best.get_crisp_assignments(), best.get_centers()

    def compute_metrics_for_k_range(self, frame: IntervalFrame, min_clusters: int = 2, max_clusters: int = 10, names=("silhouette", "calinski_harabasz", "davies_bouldin"), n_init: int = 3) -> DataFrame:
        from spanforge.operators.evaluate import sweep

        return sweep(frame, range(min_clusters, max_clusters + 1), names, self.distance_func, lambda k: self.cluster_and_return(frame, k, n_init, min(50, self.max_iter)))
