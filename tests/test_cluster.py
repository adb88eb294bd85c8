import numpy as np
import pytest

from spanforge.operators import evaluate, plotdata, select_k
from spanforge.operators.agglomerative import IntervalAgglomerative, cut, merge
from spanforge.operators.fcm import IntervalFuzzyCMeans
from spanforge.operators.frame import IntervalFrame
from spanforge.operators.kmeans import IntervalKMeans, centroid_frame
from tests.helpers import SIMPLE, frame, groups

TWO = {frozenset({0, 1, 2}), frozenset({3, 4, 5})}


@pytest.mark.parametrize("metric,init", [("euclidean", "k-means++"), ("hausdorff", "random"), ("jaccard", "k-means++")])
def test_kmeans(spark, metric, init):
    f = frame(spark, SIMPLE)
    m = IntervalKMeans(2, distance_func=metric, init=init, n_init=4)
    with pytest.raises(RuntimeError):
        m.predict(f)
    rows = m.fit_predict(f).select("row_id", "cluster").collect()
    assert groups(rows) == TWO
    assert groups(m.predict(f).select("row_id", "cluster").collect()) == TWO
    again = IntervalKMeans(2, distance_func=metric, init=init, n_init=4).fit(f)
    assert again.centroids_ == m.centroids_ and again.inertia_ == m.inertia_


def test_kmeans_errors(spark):
    with pytest.raises(ValueError):
        IntervalKMeans(init="nope")
    with pytest.raises(ValueError):
        IntervalKMeans(9).fit(frame(spark, SIMPLE))
    with pytest.raises(ValueError):
        IntervalKMeans(1).fit(frame(spark, [[[1, None]]]))


@pytest.mark.parametrize("adaptive", [False, True])
def test_fuzzy(spark, adaptive):
    f = frame(spark, SIMPLE)
    m = IntervalFuzzyCMeans(2, adaptive_weights=adaptive, random_state=1)
    assert m.get_objective() is None
    with pytest.raises(RuntimeError):
        m.get_membership()
    m.fit(f)
    u = [r.u for r in m.get_membership().collect()]
    assert all(sum(x) == pytest.approx(1) and min(x) >= 0 for x in u)
    assert groups(m.get_crisp_assignments().select("row_id", "cluster").collect()) == TWO
    assert m.get_centers().count() == 2
    if adaptive:
        assert np.shape(m.weights_) == (2, 2)


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward"])
def test_agglomerative(spark, linkage):
    f = frame(spark, SIMPLE)
    m = IntervalAgglomerative(2, linkage).fit(f)
    assert groups(m.labels().select("row_id", "cluster").collect()) == TWO
    assert m.linkage_frame().count() == 5 and m.tree[-1, 3] == 6
    assert groups(m.predict(f).select("row_id", "cluster").collect()) == TWO
    assert len(set(cut(m.tree, 6, 3))) in (2, 3)  # merges of equal height fall together
    assert m.get_cluster_tree_cuts([2, 3]).count() == 12 and len(set(cut(m.tree, 6, 6))) == 6
    t = m.dendrogram_threshold(2)
    assert (m.tree[:, 2] > t).sum() == 1


def test_merge_against_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(14, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for linkage in ("single", "complete", "average"):
        alive = [[i] for i in range(14)]
        heights = []
        while len(alive) > 1:
            f = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
            h, i, j = min((f(d[np.ix_(a, b)]), i, j) for i, a in enumerate(alive) for j, b in enumerate(alive) if i < j)
            heights.append(h)
            alive[i] += alive.pop(j)
        assert merge(d, linkage)[:, 2] == pytest.approx(heights)
    with pytest.raises(ValueError):
        IntervalAgglomerative(2, "median")


GOOD = [[[1, 3]] * 3, [[1.2, 3.1]] * 3, [[0.9, 2.8]] * 3, [[7, 9]] * 3, [[7.2, 9.1]] * 3, [[6.9, 8.8]] * 3]


def with_label(spark, labels):
    f = frame(spark, GOOD)
    df = f.df.join(spark.createDataFrame(list(enumerate(labels)), "row_id long, cluster int"), "row_id")
    g = IntervalFrame(df, "row_id")
    centres = df.groupBy("cluster").avg(*g.bound_columns)
    return g, centres.toDF("cluster", *g.bound_columns)


def test_indices(spark):
    good, bad = with_label(spark, [0, 0, 0, 1, 1, 1]), with_label(spark, [0, 1, 0, 1, 0, 1])
    for name in ("distortion", "silhouette", "calinski_harabasz", "davies_bouldin", "dunn"):
        a, b = (evaluate.evaluate(x, "cluster", c, "euclidean", name) for x, c in (good, bad))
        assert (a > b) == evaluate.MAXIMIZE[name], name
    one, c = with_label(spark, [0] * 6)
    assert [evaluate.evaluate(one, "cluster", c, "euclidean", n) for n in ("silhouette", "calinski_harabasz", "davies_bouldin", "dunn")] == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        evaluate.evaluate(one, "cluster", c, "euclidean", "nope")


def test_sweep_and_gap(spark):
    f = frame(spark, GOOD)
    m = IntervalKMeans(n_init=2, max_iter=10)
    rows = m.compute_metrics_for_k_range(f, 2, 3, ("silhouette", "distortion")).collect()
    sil = {r.k: r.value for r in rows if r.metric == "silhouette"}
    assert select_k.MaxMin(metric="silhouette").evaluate({**sil, 4: -1.0}) == 2
    gap = select_k.GapStatistic(2, 1)
    dist = {r.k: r.value for r in rows if r.metric == "distortion"}
    with pytest.warns(UserWarning):
        assert gap.evaluate(dist, f, lambda x, k: m.cluster_and_return(x, k)) in dist


SERIES = {2: 100.0, 3: 60.0, 4: 30.0, 5: 25.0, 6: 22.0, 7: 20.0, 8: 19.0, 9: 18.5, 10: 18.0}


def split_by_hand(series, least=2):
    """The k whose two fitted lines leave the least weighted root mean square."""
    k, v = np.array(list(series), float), np.array(list(series.values()))
    n, best = len(k), (np.inf, k[0])
    for c in range(1, n - 1):
        if c + 1 < least or n - c - 1 < least - 1:
            continue
        cost = 0.0
        for x, y in ((k[: c + 1], v[: c + 1]), (k[c + 1 :], v[c + 1 :])):
            rest = y - np.polyval(np.polyfit(x, y, 1), x) if len(x) > 1 else np.zeros(1)
            cost += len(x) / n * np.sqrt((rest**2).mean())
        if cost < best[0] - 1e-12:
            best = cost, k[c]
    return int(best[1])


def test_select_k(spark):
    assert select_k.Elbow(second_derivative=True).evaluate(SERIES) == 4
    points = spark.createDataFrame(list(SERIES.items()), "k int, value double")
    by_window = points and select_k.elbow_curvature_frame(points).orderBy("curvature", ascending=False).first().k
    assert select_k.Elbow().evaluate(SERIES) == by_window
    assert select_k.LMethod(iterative=False).evaluate(SERIES) == split_by_hand(SERIES)
    # With two points a line at least, a lone point on the right never beats two (both are met exactly); with four it counts.
    assert select_k.LMethod(iterative=False, min_points_per_line=4).evaluate({**{k: 100.0 - k for k in range(2, 9)}, 9: 5.0, 10: 4.0, 11: 3.0}) == 8
    for seed in range(20):
        noisy = {k: float(v) for k, v in zip(range(2, 12), np.random.default_rng(seed).random(10))}
        assert select_k.LMethod(iterative=False).evaluate(noisy) == split_by_hand(noisy)
        assert select_k.LMethod(iterative=False, min_points_per_line=4).evaluate(noisy) == split_by_hand(noisy, 4)
    assert 2 <= select_k.LMethod().evaluate(SERIES) <= 5
    assert select_k.Elbow(smooth=True).evaluate(SERIES) in SERIES
    assert select_k.smoothed(np.arange(9.0) ** 2) == pytest.approx(np.arange(9.0) ** 2)
    with pytest.warns(UserWarning):
        assert select_k.GapStatistic(5, 0).evaluate(SERIES) in SERIES
    with pytest.raises(ValueError):
        select_k.MaxMin().evaluate({50: 1.0})


def test_plot_data(spark):
    f = frame(spark, [[[0, 1]] * 2, [[1, 2]] * 2, [[2, 3]] * 2])
    bounds = sorted(tuple(r) for r in plotdata.feature_bounds(f).collect())
    assert [b[1:] for b in bounds] == [(pytest.approx(-0.3), pytest.approx(3.3))] * 2
    centres = centroid_frame(f, [[(0.5, 1.5)] * 2, [(2, 3)] * 2])
    assert plotdata.clusters(None, centroids=centres) == [0, 1] and plotdata.clusters(f) == [0]
    with pytest.raises(ValueError):
        plotdata.clusters(None)
    assert plotdata.feature_names(["X", "Y"], 3) == ["X", "Y", "Feature_3"]
    cube = frame(spark, [[[0, 1]] * 3])
    faces = plotdata.cuboid_faces(cube).orderBy("face", "corner").collect()
    assert len(faces) == 24 and [(r.x, r.y, r.z) for r in faces[:4]] == [(0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1)]
    with pytest.raises(ValueError):
        plotdata.cuboid_faces(f)
    labelled = IntervalFrame(f.df.withColumn("cluster", (f.df.row_id % 2).cast("int")), "row_id")
    assert plotdata.sample_per_cluster(labelled, "cluster", 1).count() == 2
    assert plotdata.cluster_listing(labelled, "cluster").where("cluster_size = 2").count() == 4
    with pytest.raises(ValueError):
        plotdata.cluster_listing(labelled, "cluster", order=[0])
    seg = spark.createDataFrame([(1, 0.0, 0.5, 1.0, 0.5, 0.8)], "id int, x0 double, y0 double, x1 double, y1 double, target double")
    curve = {(r.half, r.point): (r.x, r.y) for r in plotdata.bezier(seg).collect()}
    assert curve[0, 0] == (0, 0.5) and curve[1, 49] == (1, 0.5) and 0.5 < curve[0, 49][1] < 0.8
    assert plotdata.radar(f).where("step = 2").count() == 3
    assert len(plotdata.heat_map(spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i int, j int, value double"), [0, 1]).columns) == 3
