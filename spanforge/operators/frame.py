"""IntervalFrame: a DataFrame whose columns come in lower/upper pairs."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = re.compile(r"(.*)_(lower|upper)$", re.IGNORECASE)


def detect(columns: Sequence[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Feature names in order of appearance, and (feature, lower, upper) of the complete pairs."""
    found: dict[str, dict[str, str]] = {}
    for c in columns:
        if m := PAIR.match(c):
            found.setdefault(m[1], {})[m[2].lower()] = c
    return list(found), [(f, b["lower"], b["upper"]) for f, b in found.items() if len(b) == 2]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class IntervalFrame:
    """Immutable: operators return new frames. Other columns are carried along.

    ``key`` names the column that orders rows where order matters.
    """

    def __init__(self, df: DataFrame, key: str | None = None):
        if not isinstance(df, DataFrame):
            raise ValueError("an IntervalFrame wraps a Spark DataFrame")
        if key is not None and key not in df.columns:
            raise ValueError(f"no column {key!r}")
        self.df, self.key = df, key

    @cached_property
    def features(self) -> list[str]:
        return detect(self.df.columns)[0]

    @cached_property
    def pairs(self) -> list[tuple[str, str, str]]:
        pairs = detect(self.df.columns)[1]
        if not pairs:
            raise ValueError("no <feature>_lower / <feature>_upper pair among the columns")
        return pairs

    @property
    def bound_columns(self) -> list[str]:
        return [c for _, lo, up in self.pairs for c in (lo, up)]

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def n_features(self) -> int:
        return len(self.pairs)

    @cached_property
    def n_samples(self) -> int:
        return self.df.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_samples, len(self.columns)

    def __len__(self) -> int:
        return self.n_samples

    def __repr__(self) -> str:
        return f"IntervalFrame(features={self.features}, columns={len(self.columns)})"

    def __getitem__(self, item):
        if isinstance(item, Column):
            return self.with_df(self.df.where(item))
        if isinstance(item, str):
            return self.df.select(quoted(item))
        return self.df.select(*map(quoted, item))

    def require_key(self) -> str:
        if self.key is None:
            raise ValueError("this operator depends on the order of rows: name a key column")
        return self.key

    def with_df(self, df: DataFrame) -> IntervalFrame:
        return IntervalFrame(df, self.key if self.key in df.columns else None)

    def copy(self) -> IntervalFrame:
        return IntervalFrame(self.df, self.key)

    def to_dataframe(self) -> DataFrame:
        return self.df

    def bounds(self, prefix: str = "") -> list[tuple[Column, Column]]:
        at = (lambda c: F.col(f"{prefix}.`{c}`")) if prefix else quoted
        return [(at(lo), at(up)) for _, lo, up in self.pairs]

    def normalise_nan(self) -> IntervalFrame:
        """NaN becomes null, as missing bounds are null everywhere here."""
        kinds = dict(self.df.dtypes)
        clean = {c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in self.bound_columns if kinds[c] in ("double", "float")}
        return self.with_df(self.df.withColumns(clean))

    def nested(self, name: str = "intervals") -> DataFrame:
        """The pairs as one array<struct<lower, upper>> column."""
        rest = [c for c in self.columns if c not in set(self.bound_columns)]
        return self.df.select(*map(quoted, rest), F.array(*(F.struct(quoted(lo).cast("double").alias("lower"), quoted(up).cast("double").alias("upper")) for _, lo, up in self.pairs)).alias(name))

    def long(self) -> DataFrame:
        """(key, dim, feature, lower, upper): one row per interval."""
        key = [quoted(self.key)] if self.key else []
        rows = [F.struct(F.lit(i).alias("dim"), F.lit(f).alias("feature"), quoted(lo).cast("double").alias("lower"), quoted(up).cast("double").alias("upper")) for i, (f, lo, up) in enumerate(self.pairs)]
        return self.df.select(*key, F.inline(F.array(*rows)))

    def midpoints(self) -> DataFrame:
        key = [quoted(self.key)] if self.key else []
        cols = [c for f, lo, up in self.pairs for c in (((quoted(lo) + quoted(up)) / 2).alias(f"{f}_mid"), (quoted(up) - quoted(lo)).alias(f"{f}_width"))]
        return self.df.select(*key, *cols)

    def describe(self) -> DataFrame:
        """(feature_bound, n, mean, std, min, q25, q50, q75, max), exact quartiles, in one pass."""
        stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        aggs = []
        for c in self.bound_columns:
            col = quoted(c).cast("double")
            aggs.append(
                F.struct(
                    F.lit(c).alias("bound"),
                    *(f(col).alias(n) for n, f in stats.items()),
                    *(F.percentile(col, q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)),
                )
            )
        return self.df.agg(F.array(*aggs).alias("s")).select(F.inline("s")).select("bound", "n", "mean", "std", "min", "q25", "q50", "q75", "max")

    def summary(self) -> dict:
        return {"shape": self.shape, "features": self.features, "columns": self.columns, "statistics": self.describe()}

    def info(self) -> dict:
        size = int(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
        return {"shape": self.shape, "estimated_kb": size / 1024}

    def validate_intervals(self, fix_invalid: bool = False) -> IntervalFrame:
        warnings.warn("validate_intervals does nothing; use the inverted-interval operators", DeprecationWarning, stacklevel=2)
        return self
