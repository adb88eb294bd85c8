"""Interval k-means: centroids are inlined as literals, every step is one aggregate job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import metrics
from spanforge.operators.frame import IntervalFrame, quoted
from spanforge.sources.readers import uniform

#: centroids[cluster][feature] = (lower, upper)
Centroids = list[list[tuple[float, float]]]


def literal(centroid: Sequence[tuple[float, float]]) -> list[tuple[Column, Column]]:
    return [(F.lit(float(lo)), F.lit(float(up))) for lo, up in centroid]


def check_whole(frame: IntervalFrame) -> int:
    """Number of rows; clustering needs every bound."""
    missing = sum((F.count(F.when(quoted(c).isNull() | F.isnan(quoted(c).cast("double")), 1)) for c in frame.bound_columns), F.lit(0))
    n, bad = frame.df.agg(F.count(F.lit(1)), missing).first()
    if bad:
        raise ValueError("clustering needs all bounds; repair missing ones first")
    return n


def nearest(bounds, centroids: Centroids, metric: Callable, similar: bool, eps: bool = True) -> Column:
    """Index of the best centroid; the first one wins ties."""
    sign = -1 if similar else 1
    scored = [F.struct((sign * metric(bounds, literal(c), eps=eps)).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(centroids)]
    return (F.least(*scored) if len(scored) > 1 else scored[0])["k"]


def own_distance(bounds, centroids: Centroids, label: Column, metric: Callable, similar: bool, eps: bool = False) -> Column:
    """Distance to the labelled centroid, 1 - s for similarities."""
    out = F.lit(None).cast("double")
    for i, c in enumerate(centroids):
        d = metric(bounds, literal(c), eps=eps)
        out = F.when(label == i, 1 - d if similar else d).otherwise(out)
    return out


def means(df: DataFrame, frame: IntervalFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(*(F.avg(quoted(c)).alias(c) for c in frame.bound_columns), F.count(F.lit(1)).alias("n"))


class IntervalKMeans:
    def __init__(self, n_clusters: int = 3, max_iter: int = 100, tol: float = 1e-4, distance_func="euclidean", init: str = "k-means++", n_init: int = 10, random_state: int = 42):
        if init not in ("random", "k-means++"):
            raise ValueError(f"unknown init {init!r}; known: 'random', 'k-means++'")
        self.n_clusters, self.max_iter, self.tol, self.distance_func = n_clusters, max_iter, tol, distance_func
        self.init, self.n_init, self.random_state = init, n_init, random_state
        self.metric, self.similar = metrics.resolve(distance_func)
        self.centroids_: Centroids | None = None

    # Initial centroids ------------------------------------------------------

    def _draw(self, frame: IntervalFrame, runs: list[int], chosen: list[Centroids], step: int) -> list[list[tuple[float, float]]]:
        """One row per run, drawn with weight (distance to the nearest chosen)^2: the row with the
        smallest exponential race time -ln(u) / weight. Rows of weight zero come last, lowest key first."""
        key = quoted(frame.require_key())
        bounds = frame.bounds()
        row = F.struct(*(c for pair in bounds for c in pair))
        picks = []
        for run, centres in zip(runs, chosen):
            u = uniform(key, self.random_state, run, step)
            if centres and self.init == "k-means++":
                d = [self.metric(bounds, literal(c), eps=False) for c in centres]
                d = [1 - x if self.similar else x for x in d]
                low = F.least(*d) if len(d) > 1 else d[0]
                race = F.when(low > 0, -F.log(u) / F.when(low > 0, low * low).otherwise(F.lit(1.0)))
            else:
                race = -F.log(u)
            picks.append(F.min_by(row, F.struct(race.isNull(), race, key)).alias(f"r{run}"))
        got = frame.df.agg(*picks).first()
        flat = [list(map(float, got[f"r{run}"])) for run in runs]
        return [list(zip(x[::2], x[1::2])) for x in flat]

    def initial(self, frame: IntervalFrame) -> list[Centroids]:
        runs = list(range(self.n_init))
        if self.init == "random":
            key = quoted(frame.require_key())
            out = []
            for run in runs:
                flat = [c.alias(f"c{i}") for i, c in enumerate(c for p in frame.bounds() for c in p)]
                rows = frame.df.orderBy(uniform(key, self.random_state, run), key).limit(self.n_clusters).select(*flat).collect()
                out.append([list(zip(map(float, r[::2]), map(float, r[1::2]))) for r in map(list, rows)])
            return out
        chosen: list[Centroids] = [[] for _ in runs]
        for step in range(self.n_clusters):
            for centres, row in zip(chosen, self._draw(frame, runs, chosen, step)):
                centres.append(row)
        return chosen

    # Lloyd --------------------------------------------------------------------

    def lloyd(self, frame: IntervalFrame, starts: list[Centroids]) -> list[dict]:
        """All runs in one job per iteration. A run ends when no label changes or its centroids move by less than ``tol``."""
        bounds, d = frame.bounds(), frame.n_features
        state = [{"centroids": s, "labelled": s, "before": None, "n_iter": 0, "done": False} for s in starts]
        for it in range(self.max_iter):
            live = [i for i, s in enumerate(state) if not s["done"]]
            if not live:
                break
            rows = []
            for i in live:
                s = state[i]
                label = nearest(bounds, s["centroids"], self.metric, self.similar)
                before = nearest(bounds, s["before"], self.metric, self.similar) if s["before"] is not None else F.lit(-1)
                rows.append(F.struct(F.lit(i).alias("run"), label.alias("cluster"), before.alias("before")))
            long = frame.df.select(*(c.alias(f"b{j}") for j, c in enumerate(c for p in bounds for c in p)), F.explode(F.array(*rows)).alias("x"))
            sums = long.groupBy("x.run", "x.cluster").agg(*(F.avg(f"b{j}").alias(f"b{j}") for j in range(2 * d)), F.sum((F.col("x.cluster") != F.col("x.before")).cast("long")).alias("changed")).collect()  # runs * clusters rows
            for i in live:
                s = state[i]
                s["n_iter"] = it + 1
                mine = {r.cluster: r for r in sums if r.run == i}
                s["labelled"] = s["centroids"]
                if it and sum(r.changed for r in mine.values()) == 0:
                    s["done"] = True
                    continue
                new = [[(float(mine[k][f"b{2 * j}"]), float(mine[k][f"b{2 * j + 1}"])) for j in range(d)] if k in mine else c for k, c in enumerate(s["centroids"])]
                moved = sum((x - y) ** 2 for a, b in zip(new, s["centroids"]) for p, q in zip(a, b) for x, y in zip(p, q))
                s["before"], s["centroids"] = s["centroids"], new
                if moved < self.tol:
                    s["done"] = True
        costs = [F.sum(F.pow(own_distance(bounds, s["centroids"], nearest(bounds, s["labelled"], self.metric, self.similar), self.metric, self.similar), 2)).alias(f"c{i}") for i, s in enumerate(state)]
        got = frame.df.agg(*costs).first()
        for i, s in enumerate(state):
            s["inertia"] = float(got[f"c{i}"])
        return state

    def fit(self, frame: IntervalFrame, starts: list[Centroids] | None = None) -> IntervalKMeans:
        n = check_whole(frame)
        if n < self.n_clusters:
            raise ValueError(f"{n} rows are fewer than {self.n_clusters} clusters")
        cached = frame.with_df(frame.df.persist())
        try:
            runs = self.lloyd(cached, starts or self.initial(cached))
        finally:
            cached.df.unpersist()
        best = min(runs, key=lambda r: r["inertia"])
        self.centroids_, self._labelled, self.inertia_, self.n_iter_ = best["centroids"], best["labelled"], best["inertia"], best["n_iter"]
        self._fitted = frame
        return self

    def _ready(self) -> None:
        if self.centroids_ is None:
            raise RuntimeError("fit first")

    def labels(self) -> DataFrame:
        """The fitted rows with their ``cluster``."""
        self._ready()
        return self._fitted.df.withColumn("cluster", nearest(self._fitted.bounds(), self._labelled, self.metric, self.similar))

    def predict(self, frame: IntervalFrame) -> DataFrame:
        """A projection, so it also works on a stream."""
        self._ready()
        return frame.df.withColumn("cluster", nearest(frame.bounds(), self.centroids_, self.metric, self.similar))

    def fit_predict(self, frame: IntervalFrame) -> DataFrame:
        return self.fit(frame).labels()

    def centroids(self) -> DataFrame:
        self._ready()
        return centroid_frame(self._fitted, self.centroids_)

    def compute_metrics_for_k_range(self, frame: IntervalFrame, min_clusters: int = 2, max_clusters: int = 10, names: Sequence[str] = ("distortion", "silhouette", "calinski_harabasz", "davies_bouldin", "dunn")) -> DataFrame:
        from spanforge.operators.evaluate import sweep

        return sweep(frame, range(min_clusters, max_clusters + 1), names, self.distance_func, lambda k: self.cluster_and_return(frame, k))

    def cluster_and_return(self, frame: IntervalFrame, k: int) -> tuple[DataFrame, DataFrame]:
        model = IntervalKMeans(k, self.max_iter, self.tol, self.distance_func, self.init, self.n_init, self.random_state).fit(frame)
        return model.labels(), model.centroids()


def centroid_frame(frame: IntervalFrame, centroids: Centroids) -> DataFrame:
    spark = frame.df.sparkSession
    schema = "cluster int, " + ", ".join(f"`{c}` double" for c in frame.bound_columns)
    return spark.createDataFrame([(i, *(float(x) for pair in c for x in pair)) for i, c in enumerate(centroids)], schema)
