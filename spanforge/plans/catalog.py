"""Registered interval queries and their SQL counterparts.

Values are rounded to six digits in both engines; identifiers are kept.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import metrics
from spanforge.operators import clean, evaluate, fcm, kmeans, normalize, pairs, plotdata, select_k
from spanforge.operators.agglomerative import IntervalAgglomerative
from spanforge.operators.frame import IntervalFrame, quoted
from spanforge.plans import oracle
from spanforge.plans.fixtures import K_SERIES, dirty, part, quartiles
from spanforge.sources import readers


def to_digits(value: Column, digits: int) -> Column:
    """Half away from zero, as F.round, without its decimals: those cost more than comparing two rows."""
    scaled = value * (10.0**digits)
    whole = F.rint(scaled)
    half = F.abs(scaled - whole) == 0.5
    return F.when(F.abs(scaled) < 2.0**52, F.when(half, scaled + F.signum(scaled) * 0.5).otherwise(whole) / (10.0**digits)).otherwise(value)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds doubles; -0.0 becomes 0.0."""
    return df.select(*((to_digits(quoted(c), digits) + F.lit(0.0)).alias(c) if t == "double" else quoted(c) for c, t in df.dtypes))


def stored(spark, sf, view: str) -> IntervalFrame:
    """The quartiles of a view, written once: a row a group, which most queries read several times."""
    frame, path = quartiles(spark, sf, view), new_folder(spark, view)
    frame.df.write.parquet(path)
    return frame.with_df(spark.read.schema(frame.df.schema).parquet(path))


def supplier(spark, sf):
    return stored(spark, sf, "iv_supplier")


def nation(spark, sf):
    return stored(spark, sf, "iv_nation")


def user(spark, sf):
    return stored(spark, sf, "iv_user")


def scaled(frame: IntervalFrame) -> IntervalFrame:
    return normalize.MinMax().fit_transform(frame)


def first_rows(frame: IntervalFrame, k: int) -> kmeans.Centroids:
    rows = frame.df.orderBy("row_id").limit(k).collect()
    return [[(float(r[lo]), float(r[up])) for _, lo, up in frame.pairs] for r in rows]


def new_folder(spark, name: str) -> str:
    """A path in the folder that executors share; a temporary one in local mode without it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spanforge-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def middle_distance(a, b):
    """A metric of a caller's own: the midpoints' distances, added up."""
    return metrics.total(F.abs((p[0] + p[1]) / 2 - (q[0] + q[1]) / 2) for p, q in zip(a, b))


def labelled(spark, sf, k: int = 3) -> tuple[IntervalFrame, DataFrame]:
    """Supplier intervals, scaled, with the label row_id % k, and the clusters' means."""
    frame = scaled(supplier(spark, sf))
    df = frame.df.withColumn("cluster", (F.col("row_id") % k).cast("int"))
    centres = df.groupBy("cluster").agg(*(F.avg(c).alias(c) for c in frame.bound_columns))
    return IntervalFrame(df, "row_id"), centres


def lloyd(spark, sf, steps: int, k: int = 3):
    """Assignment after ``steps`` updates from the k first rows."""
    frame = scaled(supplier(spark, sf))
    model = kmeans.IntervalKMeans(k, max_iter=steps + 1, tol=0.0)
    centroids = first_rows(frame, k)
    for _ in range(steps):
        label = kmeans.nearest(frame.bounds(), centroids, model.metric, model.similar)
        got = {r.cluster: r for r in frame.df.withColumn("cluster", label).groupBy("cluster").agg(*(F.avg(c).alias(c) for c in frame.bound_columns)).collect()}
        centroids = [[(float(got[i][lo]), float(got[i][up])) for _, lo, up in frame.pairs] if i in got else c for i, c in enumerate(centroids)]
    return frame, model, centroids


def assigned(spark, sf, steps):
    frame, model, c = lloyd(spark, sf, steps)
    return frame.df.select("row_id", kmeans.nearest(frame.bounds(), c, model.metric, model.similar).cast("long").alias("cluster"))


def fuzzy(spark, sf, k: int = 2, m: float = 2.0):
    frame = scaled(user(spark, sf))
    centres = first_rows(frame, k)
    d = fcm.feature_distances(frame.bounds(), centres, metrics.euclidean, False)
    return frame, d, fcm.memberships(d, None, m)


def k_points(spark) -> DataFrame:
    return spark.createDataFrame(list(K_SERIES), "k int, value double")


def _points(spark, row):
    return spark.createDataFrame([row], "k int")


def normalised(make, fixture, undo: bool = False):
    def query(spark, sf):
        frame = fixture(spark, sf)
        n = make().fit(frame)
        out = n.transform(frame)
        if undo:
            out = n.inverse_transform(out)
        return rounded(out.df)

    return query


def partition(frame: IntervalFrame, linkage: str, k: int = 3) -> DataFrame:
    """Row and the smallest row of its cluster: free of cluster numbers."""
    rows = IntervalAgglomerative(k, linkage).fit_predict(frame).select("row_id", "cluster")
    first = rows.groupBy("cluster").agg(F.min("row_id").alias("first_row"))
    return rows.join(first, "cluster").select("row_id", "first_row")


def flagship(spark, sf_dir):
    frame = scaled(supplier(spark, sf_dir))
    model = kmeans.IntervalKMeans(3, random_state=7, n_init=2).fit(frame)
    return rounded(kmeans.means(model.labels(), frame, "cluster"))


def queries():
    q = {}
    for name in metrics.DISTANCES:
        q[f"pair_{name}"] = lambda spark, sf, name=name: rounded(pairs.upper(supplier(spark, sf), name))
    q["pair_euclidean_optimized"] = lambda spark, sf: rounded(pairs.upper(scaled(supplier(spark, sf)), "euclidean_optimized"))
    for name in metrics.SIMILARITIES:
        q[f"pair_{name}"] = lambda spark, sf, name=name: rounded(pairs.upper(supplier(spark, sf), name))
    two = lambda frame: IntervalFrame(frame.df.select("row_id", *(c.alias(f"f{i}_{s}") for i, p in enumerate(frame.bounds()[:2]) for s, c in zip(("lower", "upper"), p))), "row_id")
    q["matrix_distance"] = lambda spark, sf: rounded(pairs.pairwise_distance(nation(spark, sf), "hausdorff"))
    q["matrix_similarity"] = lambda spark, sf: rounded(pairs.pairwise_similarity(nation(spark, sf), "jaccard"))
    q["condensed_euclidean"] = lambda spark, sf: rounded(pairs.condensed(nation(spark, sf), "euclidean"))
    q["cross_distance"] = lambda spark, sf: rounded(pairs.cross_distance(two(nation(spark, sf)), two(supplier(spark, sf)), "manhattan"))
    q["cross_similarity"] = lambda spark, sf: rounded(pairs.cross_similarity(two(nation(spark, sf)), two(supplier(spark, sf)), "hedjazi"))
    q["sim_to_dist"] = lambda spark, sf: rounded(pairs.upper(nation(spark, sf), "dice").select("i", "j", metrics.sim_to_dist(F.col("value")).alias("value")))
    q["dist_to_sim"] = lambda spark, sf: rounded(pairs.upper(nation(spark, sf), "manhattan").select("i", "j", metrics.dist_to_sim(F.col("value")).alias("value")))

    q["norm_minmax"] = normalised(normalize.MinMax, dirty)
    q["norm_minmax_range"] = normalised(lambda: normalize.MinMax((-1.0, 1.0)), user)
    q["norm_zscore"] = normalised(normalize.ZScore, dirty)
    q["norm_midwidth"] = normalised(normalize.MidpointWidth, user)
    q["norm_robust"] = normalised(normalize.RobustQuantile, dirty)
    q["inv_minmax"] = normalised(normalize.MinMax, user, True)
    q["inv_zscore"] = normalised(normalize.ZScore, user, True)
    q["inv_midwidth"] = normalised(normalize.MidpointWidth, user, True)
    q["inv_robust"] = normalised(normalize.RobustQuantile, user, True)

    inverted, missing = clean.InvertedIntervals(), clean.MissingIntervals()
    q["inverted_details"] = lambda spark, sf: rounded(inverted.details(dirty(spark, sf)))
    q["inverted_by_feature"] = lambda spark, sf: inverted.by_feature(dirty(spark, sf))
    q["inverted_rows"] = lambda spark, sf: inverted.rows(dirty(spark, sf))
    for action in ("swap", "remove", "set_nan"):
        q[f"fix_{action}"] = lambda spark, sf, action=action: rounded(inverted.fix(dirty(spark, sf), action).df)
    q["missing_details"] = lambda spark, sf: missing.details(dirty(spark, sf))
    q["missing_by_feature"] = lambda spark, sf: missing.by_feature(dirty(spark, sf))
    for action in ("drop_rows", "fill_mean", "fill_median", "fill_mode", "fill_forward", "fill_backward", "fill_custom"):
        q[action] = lambda spark, sf, action=action: rounded(missing.fix(dirty(spark, sf), action, 1.5 if action == "fill_custom" else None).df)
    q["impute_joint_mean"] = lambda spark, sf: rounded(clean.impute_jointly(dirty(spark, sf), "mean").df)
    q["impute_joint_median"] = lambda spark, sf: rounded(clean.impute_jointly(dirty(spark, sf), "median").df)

    q["to_long"] = lambda spark, sf: rounded(part(spark, sf).long())
    q["nested"] = lambda spark, sf: rounded(supplier(spark, sf).nested().select("row_id", F.size("intervals").cast("long").alias("n"), F.col("intervals")[1]["upper"].alias("second_upper")))
    q["midpoints"] = lambda spark, sf: rounded(part(spark, sf).midpoints())
    q["describe"] = lambda spark, sf: rounded(user(spark, sf).describe(), 4)

    def csv_round_trip(spark, sf):
        path = new_folder(spark, "csv")
        readers.save_to_csv(part(spark, sf), path)
        got = readers.from_csv(spark, path, "row_id")
        return rounded(got.df.select(F.col("row_id").cast("long"), *(quoted(c).cast("double") for c in got.bound_columns)))

    def parquet_round_trip(spark, sf):
        path = new_folder(spark, "parquet")
        dirty(spark, sf).df.write.parquet(path)
        return rounded(readers.from_parquet(spark, path, "row_id").df)

    def frame_facts(spark, sf):
        frame = user(spark, sf)
        return spark.createDataFrame([(*frame.shape, frame.n_features, len(frame.copy()))], "n_rows long, n_columns long, n_features long, n_copied long")

    def damage(spark, sf):
        frame = dirty(spark, sf)
        bad, gone = inverted.check(frame), missing.check(frame)
        row = (bad["has_inverted"], bad["total_inverted"], bad["inverted_rows"].count(), clean.has_missing(frame), gone["total_missing"], gone["missing_details"].count())
        return spark.createDataFrame([row], "has_inverted boolean, total_inverted long, inverted_rows long, has_missing boolean, total_missing long, missing_rows long")

    def repaired(spark, sf):
        whole = clean.MissingIntervals.validate_and_fix(dirty(spark, sf), "drop_rows")
        return rounded(clean.InvertedIntervals.validate_and_fix(whole, "swap").df)

    def indexed(spark, sf):
        frame = dirty(spark, sf)
        return rounded(frame[F.col("qty_lower") > 10][["row_id", "price_upper"]])

    def fitted(make):
        return lambda spark, sf: rounded(make().fit(user(spark, sf)).parameters(spark))

    def indices(spark, sf):
        frame, centres = labelled(spark, sf)
        rows = [(name, float(evaluate.evaluate(frame, "cluster", centres, index=name))) for name in ("inertia", "ch_index", "db_index")]
        return rounded(spark.createDataFrame(rows, "name string, value double"))

    q |= {"csv_round_trip": csv_round_trip, "parquet_round_trip": parquet_round_trip, "frame_facts": frame_facts, "damage": damage, "repaired": repaired, "indexed": indexed, "indices": indices}
    q["ignored"] = lambda spark, sf: rounded(missing.fix(inverted.fix(dirty(spark, sf), "ignore"), "ignore").to_dataframe())
    q["impute_joint_remove"] = lambda spark, sf: rounded(clean.impute_jointly(dirty(spark, sf), "remove").df)
    q["params_minmax"], q["params_zscore"] = fitted(normalize.MinMax), fitted(normalize.ZScore)
    q["params_midwidth"], q["params_robust"] = fitted(normalize.MidpointWidth), fitted(normalize.RobustQuantile)
    q["similarity_distance"] = lambda spark, sf: rounded(pairs.upper(nation(spark, sf), metrics.SIMILARITY_DISTANCES["jaccard_distance"]))
    q["condensed_dice"] = lambda spark, sf: rounded(pairs.condensed(nation(spark, sf), "dice"))
    q["custom_metric"] = lambda spark, sf: rounded(pairs.upper(nation(spark, sf), middle_distance))
    q["heat_map"] = lambda spark, sf: rounded(plotdata.heat_map(pairs.pairwise_similarity(nation(spark, sf), "jaccard"), list(range(25))))

    for steps in (0, 1, 3):
        q[{0: "assign_nearest"}.get(steps, f"lloyd_{steps}")] = lambda spark, sf, steps=steps: assigned(spark, sf, steps)

    def inertia(spark, sf):
        frame, model, c = lloyd(spark, sf, 1)
        label = kmeans.nearest(frame.bounds(), c, model.metric, model.similar)
        return rounded(frame.df.agg(F.sum(F.pow(kmeans.own_distance(frame.bounds(), c, label, model.metric, model.similar), 2)).alias("inertia")))

    def kmeans_summary(spark, sf):
        frame = scaled(supplier(spark, sf))
        model = kmeans.IntervalKMeans(3, max_iter=3, tol=0.0).fit(frame, [first_rows(frame, 3)])
        return rounded(kmeans.means(model.predict(frame), frame, "cluster").withColumn("cluster", F.col("cluster").cast("long")))

    q["inertia"], q["kmeans_summary"] = inertia, kmeans_summary
    q["kmeans_pp"] = lambda spark, sf: kmeans.IntervalKMeans(3, n_init=2).fit(scaled(supplier(spark, sf))).centroids()
    q["kmeans_hedjazi"] = lambda spark, sf: kmeans.IntervalKMeans(3, n_init=2, distance_func="hedjazi", init="random").fit(scaled(nation(spark, sf))).centroids()
    q["kmeans_sweep"] = lambda spark, sf: kmeans.IntervalKMeans(n_init=1, max_iter=5).compute_metrics_for_k_range(scaled(nation(spark, sf)), 2, 4, ("distortion", "silhouette"))

    def fcm_membership(spark, sf):
        frame, _, u = fuzzy(spark, sf)
        return rounded(frame.df.select("row_id", *(x.alias(f"u{i}") for i, x in enumerate(u))))

    def fcm_centres(spark, sf):
        frame, _, u = fuzzy(spark, sf)
        row = frame.df.agg(*fcm.centre_sums(frame.bounds(), u, 2.0))
        cols = [(F.col(f"s{c}_{j}") / (F.col(f"w{c}") + fcm.TINY)).alias(f"c{c}_{j}") for c in range(2) for j in range(2 * frame.n_features)]
        return rounded(row.select(*cols))

    def fcm_weights(spark, sf):
        frame, d, u = fuzzy(spark, sf)
        w = fcm.weights_from(frame.df.agg(*fcm.weight_sums(d, u, 2.0)).first(), 2, frame.n_features)
        return rounded(spark.createDataFrame([(c, j, float(x)) for c, row in enumerate(w) for j, x in enumerate(row)], "cluster int, dim int, weight double"))

    def fcm_objective(spark, sf):
        frame, d, u = fuzzy(spark, sf)
        return rounded(frame.df.agg(fcm.objective(d, u, None, 2.0).alias("objective")))

    q |= {"fcm_membership": fcm_membership, "fcm_centres_1": fcm_centres, "fcm_adaptive_weights": fcm_weights, "fcm_objective": fcm_objective}
    q["fcm_fit"] = lambda spark, sf: fcm.IntervalFuzzyCMeans(2, max_iter=10, random_state=1).fit(scaled(user(spark, sf))).get_membership()
    q["fcm_fit_adaptive"] = lambda spark, sf: fcm.IntervalFuzzyCMeans(2, max_iter=10, adaptive_weights=True, random_state=1).fit(scaled(user(spark, sf))).get_crisp_assignments()

    def fcm_from_start(adaptive):
        def query(spark, sf):
            frame = scaled(user(spark, sf))
            first = (F.col("row_id") % 3 + 1) / 4
            model = fcm.IntervalFuzzyCMeans(2, max_iter=3, tol=0.0, adaptive_weights=adaptive).fit(frame, [first, 1 - first])
            u = F.col("u")
            return rounded(model.get_membership().select("row_id", u[0].alias("u0"), u[1].alias("u1")))

        return query

    q["fcm_from_start"], q["fcm_from_start_adaptive"] = fcm_from_start(False), fcm_from_start(True)

    q["distortion"] = lambda spark, sf: rounded(evaluate.distortion_frame((x := labelled(spark, sf))[0], "cluster", x[1]))
    q["silhouette"] = lambda spark, sf: rounded(evaluate.silhouette_frame(labelled(spark, sf)[0], "cluster"))
    q["calinski"] = lambda spark, sf: rounded(evaluate.calinski_harabasz_frame((x := labelled(spark, sf))[0], "cluster", x[1]))
    q["davies_bouldin"] = lambda spark, sf: rounded(evaluate.davies_bouldin_frame((x := labelled(spark, sf))[0], "cluster", x[1]))
    q["dunn"] = lambda spark, sf: rounded(evaluate.dunn_frame(labelled(spark, sf)[0], "cluster"))

    for linkage in ("single", "complete", "average", "ward"):
        q[f"agglo_{linkage}"] = lambda spark, sf, linkage=linkage: partition(scaled(nation(spark, sf)), linkage)
    q["agglo_tree"] = lambda spark, sf: rounded(IntervalAgglomerative(2, "average").fit(scaled(nation(spark, sf))).linkage_frame())
    q["agglo_cuts"] = lambda spark, sf: IntervalAgglomerative(2, "average").fit(scaled(nation(spark, sf))).get_cluster_tree_cuts(range(2, 5))

    best = lambda df, column: df.orderBy(F.col(column).desc(), "k").limit(1).select("k")
    q["elbow_curvature"] = lambda spark, sf: best(select_k.elbow_curvature_frame(k_points(spark)), "curvature")
    q["elbow_second"] = lambda spark, sf: best(select_k.elbow_second_frame(k_points(spark)), "bend")
    q["lmethod"] = lambda spark, sf: _points(spark, (select_k.LMethod(iterative=False).evaluate(dict(K_SERIES)),))
    q["lmethod_iterative"] = lambda spark, sf: _points(spark, (select_k.LMethod().evaluate(dict(K_SERIES)),))
    q["maxmin"] = lambda spark, sf: _points(spark, (select_k.MaxMin(metric="silhouette").evaluate(dict(K_SERIES)),))
    q["gap_select"] = lambda spark, sf: _points(spark, (select_k.GapStatistic.select([k for k, _ in K_SERIES], [0.1, 0.2, 0.35, 0.4, 0.41, 0.43, 0.44, 0.45, 0.46], [0.02] * 9, 10),))
    q["gap_reference"] = lambda spark, sf: select_k.GapStatistic(1, 3).references(scaled(nation(spark, sf)), 0).df

    q["random_intervals"] = lambda spark, sf: readers.random_intervals(spark, 1000, 3, seed=5).df
    q["blobs"] = lambda spark, sf: readers.interval_blobs(spark, 300, 3, 2, seed=5, with_label=True).df

    q["feature_bounds"] = lambda spark, sf: rounded(plotdata.feature_bounds((x := labelled(spark, sf))[0], x[1].drop("cluster")))
    q["unit_scale"] = lambda spark, sf: rounded(plotdata.parallel_centres(supplier(spark, sf)).withColumn("dim", F.col("dim").cast("long")))
    q["sample_per_cluster"] = lambda spark, sf: plotdata.sample_per_cluster(labelled(spark, sf)[0], "cluster", 5).select("row_id", "cluster")
    q["rectangles"] = lambda spark, sf: rounded(plotdata.rectangles(labelled(spark, sf)[0], "cluster"))
    q["cuboid_faces"] = lambda spark, sf: rounded(plotdata.cuboid_faces(supplier(spark, sf)))
    q["cluster_listing"] = lambda spark, sf: rounded(plotdata.cluster_listing(labelled(spark, sf)[0], "cluster", "width"))
    q["bundling"] = lambda spark, sf: rounded(plotdata.bundling(labelled(spark, sf)[0], "cluster"))
    q["bezier"] = lambda spark, sf: rounded(plotdata.bezier(spark.createDataFrame([(1, 0.0, 0.5, 1.0, 0.5, 0.8), (2, 0.0, 0.1, 1.0, 0.9, 0.2)], "id int, x0 double, y0 double, x1 double, y1 double, target double")))
    q["radar"] = lambda spark, sf: rounded(plotdata.radar(supplier(spark, sf)))
    return q


def oracle_sql():
    return oracle.statements()
