"""Inverted and missing bounds: reports and repairs. All repairs are projections or filters."""

from __future__ import annotations

from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from spanforge.operators.frame import IntervalFrame, quoted


class InversionAction(str, Enum):
    IGNORE = "ignore"
    SWAP = "swap"
    REMOVE = "remove"
    SET_NAN = "set_nan"


class MissingAction(str, Enum):
    IGNORE = "ignore"
    DROP_ROWS = "drop_rows"
    FILL_MEAN = "fill_mean"
    FILL_MEDIAN = "fill_median"
    FILL_MODE = "fill_mode"
    FILL_FORWARD = "fill_forward"
    FILL_BACKWARD = "fill_backward"
    FILL_CUSTOM = "fill_custom"


def _any(columns) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _action(kind, value):
    try:
        return value if isinstance(value, kind) else kind(str(value).lower())
    except ValueError:
        raise ValueError(f"unknown action {value!r}; known: {[a.value for a in kind]}") from None


class InvertedIntervals:
    """Intervals whose lower bound exceeds the upper by more than ``tolerance``; missing bounds are none."""

    def __init__(self, tolerance: float = 1e-10):
        self.tolerance = tolerance

    def _is(self, lo: Column, up: Column) -> Column:
        return F.coalesce(lo > up + F.lit(self.tolerance), F.lit(False))

    def details(self, frame: IntervalFrame) -> DataFrame:
        names = F.create_map(*(F.lit(x) for f, lo, up in frame.pairs for x in (f, f"{lo}|{up}")))
        key = frame.require_key()
        rows = frame.long().where(F.col("lower") > F.col("upper") + F.lit(self.tolerance))
        pair = F.split(names[F.col("feature")], r"\|")
        return rows.select(
            quoted(key).alias("row"), "feature", pair[0].alias("lower_column"), pair[1].alias("upper_column"), F.col("lower").alias("lower_value"), F.col("upper").alias("upper_value"), (F.col("lower") - F.col("upper")).alias("difference")
        )

    def by_feature(self, frame: IntervalFrame) -> DataFrame:
        return frame.long().groupBy("feature").agg(F.sum(self._is(F.col("lower"), F.col("upper")).cast("long")).alias("n_inverted"))

    def rows(self, frame: IntervalFrame) -> DataFrame:
        hit = _any(self._is(lo, up) for lo, up in frame.bounds())
        return frame.df.where(hit).select(quoted(frame.require_key()).alias("row")).distinct().orderBy("row")

    def check(self, frame: IntervalFrame) -> dict:
        counts = {r.feature: r.n_inverted or 0 for r in self.by_feature(frame).collect()}
        total = sum(counts.values())
        return {"has_inverted": total > 0, "total_inverted": total, "inverted_by_feature": counts, "inverted_rows": self.rows(frame), "inverted_details": self.details(frame)}

    def fix(self, frame: IntervalFrame, action: InversionAction | str = InversionAction.SWAP) -> IntervalFrame:
        action = _action(InversionAction, action)
        if action is InversionAction.IGNORE:
            return frame
        if action is InversionAction.REMOVE:
            return frame.with_df(frame.df.where(~_any(self._is(lo, up) for lo, up in frame.bounds())))
        new = {}
        for _, lo, up in frame.pairs:
            a, b = quoted(lo), quoted(up)
            hit = self._is(a, b)
            swap = action is InversionAction.SWAP
            new[lo] = F.when(hit, b).otherwise(a) if swap else F.when(~hit, a)
            new[up] = F.when(hit, a).otherwise(b) if swap else F.when(~hit, b)
        return frame.with_df(frame.df.withColumns(new))

    def report(self, frame: IntervalFrame, detailed: bool = False, most: int = 10) -> str:
        found = self.check(frame)
        n = frame.n_samples
        lines = [f"{found['total_inverted']} inverted intervals in {n} rows"]
        lines += [f"  {f}: {k} ({100 * k / max(n, 1):.2f} %)" for f, k in found["inverted_by_feature"].items() if k]
        if detailed:
            lines += [f"  row {r.row}, {r.feature}: [{r.lower_value}, {r.upper_value}]" for r in found["inverted_details"].orderBy("row", "feature").limit(most).collect()]
        return "\n".join(lines)

    @staticmethod
    def validate_and_fix(frame: IntervalFrame, action="swap", tolerance: float = 1e-10) -> IntervalFrame:
        return InvertedIntervals(tolerance).fix(frame, action)


def has_missing(frame: IntervalFrame) -> bool:
    return bool(frame.df.agg(F.max(_any(quoted(c).isNull() for c in frame.bound_columns))).first()[0])


def _nearest(column: str, order, forward: bool):
    """The row's value, else the last one before it (the first after it)."""
    if forward:
        return F.last(quoted(column), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return F.first(quoted(column), ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))


def _filled_by_range(df: DataFrame, key: str, columns: list[str], forward: bool) -> DataFrame:
    """Fills within ranges of the key; a range's outermost values, one row a range, are broadcast to the others."""
    at = quoted(key)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("c")).first().c or []
    number = F.lit(0)
    for c in sorted(set(cuts)):
        number = number + F.when(at > F.lit(c), 1).otherwise(0)
    rows = df.withColumn("_range", number)
    outer = F.max_by if forward else F.min_by
    ends = rows.groupBy("_range").agg(*(outer(quoted(c), F.when(quoted(c).isNotNull(), at)).alias(f"_e{i}") for i, c in enumerate(columns)))
    across = W.orderBy("_range")  # one row a range
    other = across.rowsBetween(W.unboundedPreceding, -1) if forward else across.rowsBetween(1, W.unboundedFollowing)
    pick = F.last if forward else F.first
    carried = ends.select("_range", *(pick(f"_e{i}", ignorenulls=True).over(other).alias(f"_c{i}") for i in range(len(columns))))
    within = W.partitionBy("_range").orderBy(at)
    joined = rows.join(F.broadcast(carried), "_range")
    return joined.withColumns({c: F.coalesce(_nearest(c, within, forward), F.col(f"_c{i}")) for i, c in enumerate(columns)}).select(*df.columns)


class MissingIntervals:
    """Intervals with a missing bound. Filling treats each bound column by itself, so a result can be inverted."""

    def details(self, frame: IntervalFrame) -> DataFrame:
        lo, up = F.col("lower").isNull(), F.col("upper").isNull()
        kind = F.when(lo & up, "both").when(lo, "lower").otherwise("upper")
        return frame.long().where(lo | up).select(quoted(frame.require_key()).alias("row"), "feature", lo.alias("lower_missing"), up.alias("upper_missing"), kind.alias("missing_type"))

    def by_feature(self, frame: IntervalFrame) -> DataFrame:
        return frame.long().groupBy("feature").agg(F.sum((F.col("lower").isNull() | F.col("upper").isNull()).cast("long")).alias("n_missing"))

    def check(self, frame: IntervalFrame) -> dict:
        counts = {r.feature: r.n_missing or 0 for r in self.by_feature(frame).collect()}
        total = sum(counts.values())
        return {"has_missing": total > 0, "total_missing": total, "missing_by_feature": counts, "missing_details": self.details(frame)}

    def fix(self, frame: IntervalFrame, action: MissingAction | str = MissingAction.DROP_ROWS, fill_value: float | None = None, partition_by: tuple[str, ...] = ()) -> IntervalFrame:
        """Forward and backward filling follow the key, over the whole table or within ``partition_by``.

        Over the whole table with a numeric key, ranges of keys are filled by
        themselves and take over the nearest value of the ranges before (or
        after) them; with another key it is one sorted run.
        """
        action = _action(MissingAction, action)
        columns = frame.bound_columns
        if action is MissingAction.IGNORE:
            return frame
        if action is MissingAction.DROP_ROWS:
            return frame.with_df(frame.df.na.drop(subset=columns))
        if action is MissingAction.FILL_CUSTOM:
            if fill_value is None:
                raise ValueError("fill_custom needs a fill_value")
            return frame.with_df(frame.df.withColumns({c: F.coalesce(quoted(c), F.lit(fill_value)) for c in columns}))
        if action in (MissingAction.FILL_FORWARD, MissingAction.FILL_BACKWARD):
            forward, key = action is MissingAction.FILL_FORWARD, frame.require_key()
            if not partition_by and isinstance(frame.df.schema[key].dataType, NumericType):
                return frame.with_df(_filled_by_range(frame.df, key, columns, forward))
            return frame.with_df(frame.df.withColumns({c: _nearest(c, W.partitionBy(*partition_by).orderBy(quoted(key)), forward) for c in columns}))
        stat = {
            MissingAction.FILL_MEAN: F.avg,
            MissingAction.FILL_MEDIAN: lambda c: F.percentile(c, 0.5),
            MissingAction.FILL_MODE: lambda c: F.coalesce(F.mode(c, deterministic=True), F.avg(c)),
        }[action]
        values = frame.df.agg(*(stat(quoted(c)).alias(f"v{i}") for i, c in enumerate(columns))).first()
        return frame.with_df(frame.df.withColumns({c: F.coalesce(quoted(c), F.lit(values[i])) for i, c in enumerate(columns)}))

    def report(self, frame: IntervalFrame, detailed: bool = False, most: int = 10) -> str:
        found = self.check(frame)
        n = frame.n_samples
        lines = [f"{found['total_missing']} intervals with a missing bound in {n} rows"]
        lines += [f"  {f}: {k} ({100 * k / max(n, 1):.2f} %)" for f, k in found["missing_by_feature"].items() if k]
        if detailed:
            lines += [f"  row {r.row}, {r.feature}: {r.missing_type}" for r in found["missing_details"].orderBy("row", "feature").limit(most).collect()]
        return "\n".join(lines)

    @staticmethod
    def validate_and_fix(frame: IntervalFrame, action="drop_rows", fill_value: float | None = None) -> IntervalFrame:
        return MissingIntervals().fix(frame, action, fill_value)


def impute_jointly(frame: IntervalFrame, method: str = "mean") -> IntervalFrame:
    """Fills a missing bound from the other one and the feature's typical width, both from
    typical midpoint and width; 'remove' drops rows; another method changes nothing.

    Features without a whole interval stay as they are.
    """
    if method == "remove":
        return frame.with_df(frame.df.na.drop(subset=frame.bound_columns))
    if method not in ("mean", "median"):
        return frame
    stat = F.avg if method == "mean" else (lambda c: F.percentile(c, 0.5))
    aggs = [a for i, (lo, up) in enumerate(frame.bounds()) for a in (stat((lo + up) / 2).alias(f"m{i}"), stat(up - lo).alias(f"w{i}"))]
    s = frame.df.agg(*aggs).first()
    new = {}
    for i, (_, lo, up) in enumerate(frame.pairs):
        a, b, mid, width = quoted(lo), quoted(up), s[f"m{i}"], s[f"w{i}"]
        if mid is None:
            continue
        new[lo] = F.when(a.isNull() & b.isNull(), F.lit(mid - width / 2)).when(a.isNull(), b - width).otherwise(a)
        new[up] = F.when(a.isNull() & b.isNull(), F.lit(mid + width / 2)).when(b.isNull(), a + width).otherwise(b)
    return frame.with_df(frame.df.withColumns(new))
