"""The number of clusters from a short series of (k, value)."""

from __future__ import annotations

import math
import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.operators.evaluate import MAXIMIZE
from spanforge.operators.frame import IntervalFrame
from spanforge.sources.readers import uniform


def series(values: Mapping[int, float] | np.ndarray | DataFrame, low: int = 2, high: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(k, value) in order of k, within [low, high]."""
    if isinstance(values, DataFrame):
        values = {r.k: r.value for r in values.select("k", "value").limit(10_000).collect()}
    items = sorted(values.items()) if isinstance(values, Mapping) else sorted(map(tuple, np.asarray(values)))
    items = [(int(k), float(v)) for k, v in items if low <= k <= high]
    if len(items) < 3:
        warnings.warn("fewer than three points", stacklevel=2)
    return np.array([k for k, _ in items]), np.array([v for _, v in items], dtype=float)


class Evaluator(ABC):
    def __init__(self, min_clusters: int = 2, max_clusters: int = 20):
        self.min_clusters, self.max_clusters = min_clusters, max_clusters

    def _series(self, values):
        k, v = series(values, self.min_clusters, self.max_clusters)
        if not len(k):
            raise ValueError("no point within the range")
        return k, v

    @abstractmethod
    def evaluate(self, values) -> int: ...


def smoothed(v: np.ndarray) -> np.ndarray:
    """Savitzky-Golay, order 2, window min(5, n - 2) made odd; edges by the outermost fit."""
    n = len(v)
    if n < 5:
        return v
    w = min(5, n - 2)
    w -= 1 - w % 2
    if w < 3:
        return v
    h = w // 2
    x = np.arange(-h, h + 1)
    fit = lambda y: np.polynomial.polynomial.polyfit(x, y, min(2, w - 1))
    at = lambda c, t: sum(ci * t**i for i, ci in enumerate(c))
    out = np.array([at(fit(v[i - h : i + h + 1]), 0) if h <= i < n - h else 0.0 for i in range(n)])
    first, last = fit(v[:w]), fit(v[-w:])
    for t in range(h):
        out[t] = at(first, t - h)
        out[n - 1 - t] = at(last, h - t)
    return out


class Elbow(Evaluator):
    def __init__(self, second_derivative: bool = False, smooth: bool = False, **bounds):
        super().__init__(**bounds)
        self.second_derivative, self.smooth = second_derivative, smooth

    def evaluate(self, values) -> int:
        k, v = self._series(values)
        if self.smooth:
            v = smoothed(v)
        if len(k) < 3:
            return int(k[0])
        if self.second_derivative:
            bend = np.diff(np.diff(v) / np.diff(k))
            return int(k[(bend.argmax() if v.mean() >= 0 else bend.argmin()) + 1])
        slope = np.gradient(v)
        return int(k[(np.abs(np.gradient(slope)) / (1 + slope**2) ** 1.5).argmax()])


def elbow_curvature_frame(points: DataFrame) -> DataFrame:
    """(k, curvature): the same on a DataFrame of (k, value), by windows."""
    o = W.orderBy("k")

    def gradient(df: DataFrame, source: str, name: str) -> DataFrame:
        before, after, here = F.lag(source).over(o), F.lead(source).over(o), F.col(source)
        return df.withColumn(name, F.when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2))

    bent = gradient(gradient(points, "value", "_d1"), "_d1", "_d2")
    return bent.select("k", (F.abs("_d2") / F.pow(1 + F.col("_d1") * F.col("_d1"), F.lit(1.5))).alias("curvature"))


def elbow_second_frame(points: DataFrame) -> DataFrame:
    """(k, bend): change of the slope before and after k."""
    o = W.orderBy("k")
    sloped = points.withColumn("_s", (F.lead("value").over(o) - F.col("value")) / (F.lead("k").over(o) - F.col("k")))
    return sloped.withColumn("bend", F.col("_s") - F.lag("_s").over(o)).where("bend is not null").select("k", "bend")


class LMethod(Evaluator):
    """Two straight lines; the knee is the last point of the left one.

    The left line has ``min_points_per_line`` points at least, two in any case;
    the right one may have one less, and fits a lone point exactly.
    """

    def __init__(self, iterative: bool = True, min_points_per_line: int = 2, **bounds):
        super().__init__(**bounds)
        self.iterative, self.least = iterative, min_points_per_line

    @staticmethod
    def _rmse(k, v) -> float:
        x = k - k.mean()
        ss = float((x * x).sum())
        slope = float((x * (v - v.mean())).sum()) / ss if ss else 0.0
        r = v - v.mean() - slope * x
        return math.sqrt(float((r * r).mean()))

    def knee(self, k, v) -> int:
        n = len(k)
        if n < 3:
            return int(k[0])
        best, at = math.inf, None
        for c in range(max(1, self.least - 1), min(n - 1, n - self.least + 1)):
            left = c + 1
            cost = left / n * self._rmse(k[:left], v[:left]) + (n - left) / n * self._rmse(k[left:], v[left:])
            if cost < best:
                best, at = cost, c
        return int(k[0] if at is None else k[at])

    def evaluate(self, values) -> int:
        k, v = self._series(values)
        found = self.knee(k, v)
        if not self.iterative:
            return found
        while True:
            n = max(5, 2 * self.least, int((k <= 2 * found).sum()))
            nxt = self.knee(k[:n], v[:n])
            if nxt >= found or nxt <= self.min_clusters:
                return min(nxt, found)
            found = nxt


class MaxMin(Evaluator):
    def __init__(self, find_max: bool = True, metric: str | None = None, **bounds):
        super().__init__(**bounds)
        self.find_max = MAXIMIZE.get(metric, find_max) if metric else find_max

    def evaluate(self, values) -> int:
        k, v = self._series(values)
        return int(k[v.argmax() if self.find_max else v.argmin()])


class GapStatistic(Evaluator):
    """Against reference sets drawn uniformly in each bound's range (so references may be inverted)."""

    def __init__(self, n_refs: int = 10, random_state: int | None = None, **bounds):
        super().__init__(**bounds)
        self.n_refs, self.random_state = n_refs, random_state

    def references(self, frame: IntervalFrame, ref: int) -> IntervalFrame:
        key = frame.require_key()
        lo_hi = frame.df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(frame.bound_columns) for n, f in (("a", F.min), ("b", F.max)))).first()
        draw = lambda i: F.lit(float(lo_hi[f"a{i}"])) + uniform(F.col(key), self.random_state or 0, "ref", ref, i) * float(lo_hi[f"b{i}"] - lo_hi[f"a{i}"])
        return IntervalFrame(frame.df.select(key, *(draw(i).alias(c) for i, c in enumerate(frame.bound_columns))), key)

    @staticmethod
    def dispersion(labelled: DataFrame, centers: DataFrame, frame: IntervalFrame) -> float:
        """Sum of squared Euclidean distances to the own centre."""
        own = centers.select("cluster", *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(frame.bound_columns)))
        square = sum((F.pow(F.col(f"`{c}`") - F.col(f"_c{i}"), 2) for i, c in enumerate(frame.bound_columns)), F.lit(0.0))
        return float(labelled.join(F.broadcast(own), "cluster").agg(F.sum(square)).first()[0] or 0.0)

    @staticmethod
    def select(k, gap, sd, n_refs: int) -> int:
        """The first k behind an outstanding jump; else the first gap not beaten by more than one error; else the last k."""
        gap, s = np.asarray(gap), np.asarray(sd) * math.sqrt(1 + 1 / n_refs)
        jump = np.diff(gap)
        if len(jump) and (high := np.flatnonzero(jump > jump.mean() + jump.std())).size:
            return int(k[high[0] + 1])
        for i in range(len(gap) - 1):
            if gap[i] >= gap[i + 1] - s[i + 1]:
                return int(k[i])
        return int(k[-1])

    def evaluate(self, values, frame: IntervalFrame | None = None, cluster_func: Callable[[IntervalFrame, int], tuple[DataFrame, DataFrame]] | None = None) -> int:
        k, v = self._series(values)
        log = lambda x: math.log(x) if x > 0 else 0.0
        own = np.array([log(x) for x in v])
        if frame is None or cluster_func is None:
            warnings.warn("without data the references are a synthetic line", stacklevel=2)
            rng = np.random.default_rng(self.random_state)
            line = np.log(np.maximum(np.linspace(v.max(), 0.8 * v.min(), len(k)), 1e-12))
            refs = line + rng.normal(0, 0.1, (self.n_refs, len(k)))
        else:
            sets = [self.references(frame, r) for r in range(self.n_refs)]
            refs = np.array([[log(self.dispersion(*cluster_func(s, int(c)), s)) for c in k] for s in sets])
        self.k_, self.gap_, self.sd_ = k, refs.mean(axis=0) - own, refs.std(axis=0)
        return self.select(k, self.gap_, self.sd_, self.n_refs)


__all__ = ["Elbow", "Evaluator", "GapStatistic", "LMethod", "MaxMin", "elbow_curvature_frame", "elbow_second_frame", "series", "smoothed"]
