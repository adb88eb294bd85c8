"""Interval distances and similarities as Column expressions, unrolled over features.

A row is given by its bounds: ``side`` maps (feature, "lower" | "upper") to a
Column, so that the same builder serves joins, literals and nested columns. A
missing bound makes the whole value null.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (lower, upper) per feature.
Bounds = Sequence[tuple[Column, Column]]
#: What batch comparisons add under the root, so that equal rows are 1e-8 apart.
EPS = 1e-16


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def known(value: Column, *sides: Bounds) -> Column:
    """``value``, or null where any bound is: greatest and least would skip nulls.

    The value stands outside the condition, where Spark evaluates what it repeats once.
    """
    missing = reduce(lambda a, b: a | b, [c.isNull() for s in sides for pair in s for c in pair])
    return value + F.when(missing, F.lit(None).cast("double")).otherwise(F.lit(0.0))


def _gaps(a: Bounds, b: Bounds) -> list[tuple[Column, Column]]:
    return [(F.abs(p[0] - q[0]), F.abs(p[1] - q[1])) for p, q in zip(a, b, strict=True)]


def _largest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def hausdorff(a: Bounds, b: Bounds, eps: bool = False) -> Column:
    """Sum over features of the larger bound difference."""
    return known(total(F.greatest(x, y) for x, y in _gaps(a, b)), a, b)


def manhattan(a: Bounds, b: Bounds, eps: bool = False) -> Column:
    return known(total(x + y for x, y in _gaps(a, b)), a, b)


def chebyshev(a: Bounds, b: Bounds, eps: bool = False) -> Column:
    return known(_largest([c for pair in _gaps(a, b) for c in pair]), a, b)


def euclidean(a: Bounds, b: Bounds, eps: bool = False) -> Column:
    squares = total(x * x + y * y for x, y in _gaps(a, b))
    return F.sqrt(squares + F.lit(EPS)) if eps else F.sqrt(squares)


def squared_norm(a: Bounds) -> Column:
    return total(lo * lo + up * up for lo, up in a)


def dot(a: Bounds, b: Bounds) -> Column:
    return total(p[0] * q[0] + p[1] * q[1] for p, q in zip(a, b, strict=True))


def euclidean_optimized(a: Bounds, b: Bounds, eps: bool = True) -> Column:
    """Through norms and the inner product; the small constant always counts."""
    return F.sqrt(F.greatest(squared_norm(a) + squared_norm(b) - 2 * dot(a, b), F.lit(0.0)) + F.lit(EPS))


def cosine(a: Bounds, b: Bounds, eps: bool = False) -> Column:
    norms = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    if eps:
        return known(F.least(F.greatest(1 - dot(a, b) / (norms + F.lit(EPS)), F.lit(0.0)), F.lit(2.0)), a, b)
    return known(1 - ratio(dot(a, b), norms), a, b)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, or 0 where the whole is not positive. Each side stands once, so that nested ratios stay small."""
    return F.coalesce(positive_ratio(part, whole), F.lit(0.0))


def positive_ratio(part: Column, whole: Column) -> Column:
    """part / whole, or null where the whole is not positive."""
    return F.try_divide(part, F.greatest(whole, F.lit(0.0)))


def _mean(per_feature) -> Callable[[Bounds, Bounds], Column]:
    def similarity(a: Bounds, b: Bounds, eps: bool = False) -> Column:
        values = []
        for (la, ua), (lb, ub) in zip(a, b, strict=True):
            shared = F.greatest(F.lit(0.0), F.least(ua, ub) - F.greatest(la, lb))
            values.append(per_feature(la, ua, lb, ub, shared))
        return known(total(values) / len(values), a, b)

    return similarity


def _two_ratios(la, ua, lb, ub, shared):
    return (ratio(shared, shared + F.greatest(F.lit(0.0), (ua - la) - shared)), ratio(shared, shared + F.greatest(F.lit(0.0), (ub - lb) - shared)))


def _hedjazi(la, ua, lb, ub, shared):
    union = (ua - la) + (ub - lb) - shared
    gap = F.greatest(F.lit(0.0), F.greatest(la, lb) - F.least(ua, ub))
    span = F.greatest(ua, ub) - F.least(la, lb)
    return F.coalesce(0.5 * (positive_ratio(shared, union) + 1 - positive_ratio(gap, span)), F.lit(0.0))


jaccard = _mean(lambda la, ua, lb, ub, shared: ratio(shared, (ua - la) + (ub - lb) - shared))
dice = _mean(lambda la, ua, lb, ub, shared: ratio(2 * shared, (ua - la) + (ub - lb)))
bidirectional_min = _mean(lambda la, ua, lb, ub, shared: F.least(*_two_ratios(la, ua, lb, ub, shared)))
bidirectional_prod = _mean(lambda la, ua, lb, ub, shared: (lambda r: r[0] * r[1])(_two_ratios(la, ua, lb, ub, shared)))
hedjazi = _mean(_hedjazi)

DISTANCES: dict[str, Callable] = {
    "hausdorff": hausdorff,
    "euclidean": euclidean,
    "euclidean_optimized": euclidean_optimized,
    "manhattan": manhattan,
    "chebyshev": chebyshev,
    "cosine": cosine,
}
SIMILARITIES: dict[str, Callable] = {
    "jaccard": jaccard,
    "dice": dice,
    "bidirectional_min": bidirectional_min,
    "bidirectional_prod": bidirectional_prod,
    "hedjazi": hedjazi,
}


def similarity_to_distance(f: Callable) -> Callable:
    return lambda a, b, eps=False: 1 - f(a, b)


SIMILARITY_DISTANCES = {f"{name}_distance": similarity_to_distance(f) for name, f in SIMILARITIES.items()}


def sim_to_dist(x: Column, mode: str = "1_minus") -> Column:
    if mode != "1_minus":
        raise ValueError(f"unknown conversion {mode!r}; known: '1_minus'")
    return 1 - x


def dist_to_sim(x: Column, mode: str = "1_over_1_plus") -> Column:
    """1 / (1 + x); null at x = -1."""
    if mode != "1_over_1_plus":
        raise ValueError(f"unknown conversion {mode!r}; known: '1_over_1_plus'")
    return F.try_divide(F.lit(1.0), 1 + x)


def resolve(metric: str | Callable, is_similarity: bool = False) -> tuple[Callable, bool]:
    """(builder, whether it is a similarity). A callable takes two sides and returns a Column."""
    if callable(metric):
        given = [p for p in inspect.signature(metric).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
        if len(given) != 2:
            raise ValueError("a metric takes exactly two parameters")
        takes_eps = "eps" in inspect.signature(metric).parameters
        return (metric if takes_eps else lambda a, b, eps=False: metric(a, b)), bool(is_similarity)
    if metric in DISTANCES:
        return DISTANCES[metric], False
    if metric in SIMILARITIES:
        return SIMILARITIES[metric], True
    raise ValueError(f"unknown metric {metric!r}; distances: {sorted(DISTANCES)}, similarities: {sorted(SIMILARITIES)}")


def as_distance(metric: str | Callable, is_similarity: bool = False) -> Callable:
    """The metric as a distance builder: similarities become 1 - s."""
    f, similar = resolve(metric, is_similarity)
    return similarity_to_distance(f) if similar else f


def pandas_metric(f: Callable[..., float]) -> Callable:
    """A plain Python metric on two lists of [lower, upper] pairs, run in Arrow batches."""
    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        side = lambda v: [[p["lower"], p["upper"]] for p in v]
        return pd.Series([float(f(side(x), side(y))) for x, y in zip(a, b)])

    nested = lambda s: F.array(*(F.struct(lo.alias("lower"), up.alias("upper")) for lo, up in s))
    return lambda a, b, eps=False: apply(nested(a), nested(b))
