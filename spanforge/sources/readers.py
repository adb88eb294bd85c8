"""Readers, writers and generators of interval tables."""

from __future__ import annotations

import random
from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.frame import IntervalFrame


class Loader(ABC):
    @abstractmethod
    def load(self, spark: SparkSession, path: str, **options) -> DataFrame: ...


class CsvLoader(Loader):
    def load(self, spark, path, **options):
        try:
            return spark.read.options(**{"header": True, "inferSchema": True} | options).csv(path)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" in str(err):
                raise FileNotFoundError(path) from err
            raise


class ParquetLoader(Loader):
    def load(self, spark, path, **options):
        return spark.read.options(**options).parquet(path)


class ExcelLoader(Loader):
    """A spreadsheet is read on the driver, which its format bounds to about a million rows; needs openpyxl."""

    def load(self, spark, path, sheet_name=0, **options):
        import pandas as pd

        pd.io.excel  # noqa: B018
        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet_name, **options))


def from_csv(spark: SparkSession, path: str, key: str | None = None, **options) -> IntervalFrame:
    return IntervalFrame(CsvLoader().load(spark, path, **options), key).normalise_nan()


def from_parquet(spark: SparkSession, path: str, key: str | None = None, **options) -> IntervalFrame:
    return IntervalFrame(ParquetLoader().load(spark, path, **options), key).normalise_nan()


def from_excel(spark: SparkSession, path: str, sheet_name=0, key: str | None = None, **options) -> IntervalFrame:
    return IntervalFrame(ExcelLoader().load(spark, path, sheet_name=sheet_name, **options), key).normalise_nan()


def save_to_csv(frame: IntervalFrame, path: str, mode: str = "errorifexists", **options) -> None:
    frame.df.write.options(**{"header": True} | options).mode(mode).csv(path)


def save_to_excel(frame: IntervalFrame, path: str, max_rows: int = 1_048_575, **options) -> None:
    """Refuses more rows than a sheet holds."""
    rows = frame.df.limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows do not fit a sheet")
    rows.to_excel(path, index=False, **options)


def uniform(key: Column, *salt: object) -> Column:
    """A number in (0, 1) that depends on the key and the salt alone, not on partitioning."""
    h = F.xxhash64(key, *(F.lit(str(s)) for s in salt))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def normal(key: Column, *salt: object) -> Column:
    """Box-Muller on two such numbers."""
    return F.sqrt(-2 * F.log(uniform(key, *salt, "r"))) * F.cos(2 * F.pi() * uniform(key, *salt, "a"))


def random_intervals(spark: SparkSession, n_samples: int, n_features: int, lower: float = 0.0, upper: float = 100.0, seed: int = 0) -> IntervalFrame:
    """Two uniform draws per cell; the smaller is the lower bound."""
    df = spark.range(n_samples).withColumnRenamed("id", "row_id")
    draw = lambda i, side: uniform(F.col("row_id"), seed, i, side) * (upper - lower) + lower
    cols = [c for i in range(n_features) for c in (F.least(draw(i, "a"), draw(i, "b")).alias(f"Feature_{i}_lower"), F.greatest(draw(i, "a"), draw(i, "b")).alias(f"Feature_{i}_upper"))]
    return IntervalFrame(df.select("row_id", *cols), "row_id")


def interval_blobs(
    spark: SparkSession,
    n_samples: int | Sequence[int] = 100,
    n_clusters: int = 3,
    n_dims: int = 2,
    cluster_centers: Sequence | None = None,
    cluster_std_center: float | Sequence[float] = 1.0,
    cluster_std_width: float | Sequence[float] = 0.5,
    center_range: tuple[float, float] = (-10.0, 10.0),
    width_range: tuple[float, float] = (0.1, 2.0),
    min_width: float = 0.05,
    shuffle: bool = True,
    seed: int = 0,
    with_label: bool = False,
) -> IntervalFrame:
    """Clusters of intervals around centres [(midpoint, half-width) per dimension].

    An int ``n_samples`` is dealt evenly, the remainder to the first clusters; a
    list gives each cluster's size. ``shuffle`` deals row ids at random.
    """
    sizes = list(n_samples) if not isinstance(n_samples, int) else [n_samples // n_clusters + (i < n_samples % n_clusters) for i in range(n_clusters)]
    rng = random.Random(seed)
    if cluster_centers is None:
        cluster_centers = [[(rng.uniform(*center_range), rng.uniform(*width_range)) for _ in range(n_dims)] for _ in sizes]
    spread = lambda s: [float(s)] * n_dims if isinstance(s, (int, float)) else list(map(float, s))
    std_c, std_w = spread(cluster_std_center), spread(cluster_std_width)
    df = spark.range(sum(sizes))
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    label = F.lit(len(sizes) - 1)
    for i in range(len(sizes) - 2, -1, -1):
        label = F.when(F.col("id") < ends[i], i).otherwise(label)
    df = df.withColumn("label", label)
    cols = []
    for d in range(n_dims):
        centre = F.element_at(F.array(*(F.struct(F.lit(float(c[d][0])).alias("m"), F.lit(float(c[d][1])).alias("w")) for c in cluster_centers)), F.col("label") + 1)
        mid = centre["m"] + std_c[d] * normal(F.col("id"), seed, d, "mid")
        half = F.greatest(centre["w"] + std_w[d] * normal(F.col("id"), seed, d, "width"), F.lit(float(min_width)))
        cols += [(mid - half).alias(f"Feature_{d}_lower"), (mid + half).alias(f"Feature_{d}_upper")]
    row = F.xxhash64("id", F.lit(seed)) if shuffle else F.col("id")
    return IntervalFrame(df.select(row.alias("row_id"), *cols, *(["label"] if with_label else [])), "row_id")
