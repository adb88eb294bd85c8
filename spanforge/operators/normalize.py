"""Normalisers: one aggregate to fit, one projection to apply, another to undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.frame import IntervalFrame, quoted


class Normalizer:
    """``params``: feature -> fitted numbers."""

    names: tuple[str, ...] = ()

    def __init__(self):
        self.params: dict[str, tuple[float, ...]] | None = None

    def _stats(self, lo: Column, up: Column) -> list[Column]:
        raise NotImplementedError

    def _settled(self, values: tuple) -> tuple[float, ...]:
        raise NotImplementedError

    def _apply(self, lo: Column, up: Column, p: tuple) -> tuple[Column, Column]:
        raise NotImplementedError

    def _undo(self, lo: Column, up: Column, p: tuple) -> tuple[Column, Column]:
        raise NotImplementedError

    def fit(self, frame: IntervalFrame) -> Normalizer:
        k = len(self.names)
        aggs = [c.alias(f"s{i}_{j}") for i, (lo, up) in enumerate(frame.bounds()) for j, c in enumerate(self._stats(lo, up))]
        row = frame.df.agg(*aggs).first()
        self.params = {f: self._settled(tuple(row[f"s{i}_{j}"] for j in range(len(row) // frame.n_features))) for i, (f, _, _) in enumerate(frame.pairs)}
        assert all(len(p) == k for p in self.params.values())
        return self

    def _mapped(self, frame: IntervalFrame, how) -> IntervalFrame:
        if self.params is None:
            raise RuntimeError("fit first")
        new = {}
        for f, lo, up in frame.pairs:
            if f in self.params:
                new[lo], new[up] = how(quoted(lo), quoted(up), self.params[f])
        return frame.with_df(frame.df.withColumns(new))

    def transform(self, frame: IntervalFrame) -> IntervalFrame:
        return self._mapped(frame, self._apply)

    def fit_transform(self, frame: IntervalFrame) -> IntervalFrame:
        return self.fit(frame).transform(frame)

    def inverse_transform(self, frame: IntervalFrame) -> IntervalFrame:
        return self._mapped(frame, self._undo)

    def parameters(self, spark) -> DataFrame:
        if self.params is None:
            raise RuntimeError("fit first")
        return spark.createDataFrame([(f, *map(float, p)) for f, p in self.params.items()], "feature string, " + ", ".join(f"{n} double" for n in self.names))

    def report(self) -> str:
        if self.params is None:
            raise RuntimeError("fit first")
        return "\n".join(f"{f}: " + ", ".join(f"{n}={v:g}" for n, v in zip(self.names, p)) for f, p in self.params.items())


class MinMax(Normalizer):
    """Scales both bounds by the feature's whole range; a constant feature becomes the target's lower end everywhere."""

    names = ("minimum", "maximum")

    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0)):
        super().__init__()
        self.a, self.b = map(float, feature_range)

    def _stats(self, lo, up):
        whole = F.min(lo).isNotNull() & F.min(up).isNotNull()
        return [F.when(whole, F.least(F.min(lo), F.min(up))), F.when(whole, F.greatest(F.max(lo), F.max(up)))]

    def _settled(self, v):
        return (0.0, 1.0) if v[0] is None else v

    def _apply(self, lo, up, p):
        if p[0] == p[1]:
            return F.lit(self.a), F.lit(self.a)
        one = lambda c: F.lit(self.a) + (c - p[0]) * (self.b - self.a) / (p[1] - p[0])
        return one(lo), one(up)

    def _undo(self, lo, up, p):
        if p[0] == p[1]:
            return F.lit(float(p[0])), F.lit(float(p[0]))
        one = lambda c: (c - self.a) * (p[1] - p[0]) / (self.b - self.a) + p[0]
        return one(lo), one(up)


def _both(lo: Column, up: Column, value: Column, other: Column) -> Column:
    return F.when(lo.isNotNull() & up.isNotNull(), value).otherwise(other)


class ZScore(Normalizer):
    """Midpoints to mean 0 and sample deviation 1, widths by the same deviation."""

    names = ("mean", "std")

    def _stats(self, lo, up):
        mid = (lo + up) / 2
        return [F.avg(mid), F.stddev_samp(mid)]

    def _settled(self, v):
        if v[0] is None:
            return (0.0, 1.0)
        return (v[0], float("nan") if v[1] is None else 1.0 if v[1] == 0 else v[1])

    def _map(self, lo, up, f):
        mid, half = f((lo + up) / 2, (up - lo) / 2)
        return _both(lo, up, mid - half, lo), _both(lo, up, mid + half, up)

    def _apply(self, lo, up, p):
        if p[1] != p[1]:  # one row has no deviation
            return F.lit(None).cast("double"), F.lit(None).cast("double")
        return self._map(lo, up, lambda m, h: ((m - p[0]) / p[1], h / p[1]))

    def _undo(self, lo, up, p):
        return self._map(lo, up, lambda m, h: (m * p[1] + p[0], h * p[1]))


class MidpointWidth(Normalizer):
    """Midpoints and widths scaled to [0, 1] each, then put together again; bounds may leave [0, 1]."""

    names = ("mid_min", "mid_max", "width_min", "width_max")

    def _stats(self, lo, up):
        mid, width = (lo + up) / 2, up - lo
        return [F.min(mid), F.max(mid), F.min(width), F.max(width)]

    def _settled(self, v):
        return (0.0, 1.0, 0.0, 1.0) if v[0] is None else v

    def _apply(self, lo, up, p):
        scale = lambda c, a, b: (c - a) / (b - a) if b > a else c * 0.0
        mid, width = scale((lo + up) / 2, p[0], p[1]), scale(up - lo, p[2], p[3])
        return _both(lo, up, mid - width / 2, lo), _both(lo, up, mid + width / 2, up)

    def _undo(self, lo, up, p):
        mid, width = (lo + up) / 2 * (p[1] - p[0]) + p[0], (up - lo) * (p[3] - p[2]) + p[2]
        return _both(lo, up, mid - width / 2, lo), _both(lo, up, mid + width / 2, up)


class RobustQuantile(Normalizer):
    """Bounds by the exact low quantile of lowers and high quantile of uppers, clipped to [0, 1]."""

    names = ("low", "high")

    def __init__(self, q_low: float = 0.05, q_high: float = 0.95):
        super().__init__()
        self.q_low, self.q_high = q_low, q_high

    def _stats(self, lo, up):
        return [F.percentile(lo, self.q_low), F.percentile(up, self.q_high)]

    def _settled(self, v):
        return (0.0, 1.0) if v[0] is None or v[1] is None else v

    def _apply(self, lo, up, p):
        def one(c):
            scaled = (c - p[0]) / (p[1] - p[0]) if p[1] != p[0] else c * 0.0
            return F.when(c.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))

        return one(lo), one(up)

    def _undo(self, lo, up, p):
        one = lambda c: c * (p[1] - p[0]) + p[0]
        return one(lo), one(up)
