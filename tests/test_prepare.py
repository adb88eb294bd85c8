import pytest
from pyspark.sql import functions as F

from spanforge.operators import clean, normalize
from spanforge.operators.frame import IntervalFrame, detect
from spanforge.sources import readers
from tests.helpers import cells, frame


def test_detection():
    assert detect(["a_lower", "a_UPPER", "x", "b_lower"]) == (["a", "b"], [("a", "a_lower", "a_UPPER")])
    assert detect(["t_lower_raw", "max_x_lower", "max_x_upper", "x_lower", "x_upper"])[1] == [("max_x", "max_x_lower", "max_x_upper"), ("x", "x_lower", "x_upper")]


def test_frame(spark, tmp_path):
    f = frame(spark, [[[1, 4], [0.5, 3.5]], [[2, 5], [1.5, 4.5]]])
    assert f.features == ["f0", "f1"] and f.shape == (2, 5) and len(f) == 2
    assert [tuple(x) for x in f.nested().first().intervals] == [(1, 4), (0.5, 3.5)]
    assert f.long().count() == 4
    assert f[f.df.f0_lower > 1].n_samples == 1
    assert f["f0_lower"].columns == ["f0_lower"]
    with pytest.raises(ValueError):
        IntervalFrame([1])
    with pytest.raises(ValueError):
        IntervalFrame(spark.range(1)).pairs  # noqa: B018
    readers.save_to_csv(f, str(tmp_path / "x"))
    assert cells(readers.from_csv(spark, str(tmp_path / "x"), "row_id").df) == cells(f.df)
    with pytest.raises(FileNotFoundError):
        readers.from_csv(spark, str(tmp_path / "none"))
    with pytest.warns(DeprecationWarning):
        assert f.validate_intervals() is f


def test_generators(spark):
    r = readers.random_intervals(spark, 50, 2, 0, 10, seed=3)
    assert r.df.where("Feature_0_lower > Feature_0_upper or Feature_1_lower < 0 or Feature_1_upper > 10").count() == 0
    again = readers.random_intervals(spark, 50, 2, 0, 10, seed=3).df.repartition(7)
    assert cells(again) == cells(r.df)
    b = readers.interval_blobs(spark, [3, 5], n_dims=2, seed=1, with_label=True)
    assert sorted(x["count"] for x in b.df.groupBy("label").count().collect()) == [3, 5]
    assert b.df.where("Feature_0_upper - Feature_0_lower < 0.0999").count() == 0


INVERTED = [[[1, 3], [2, 5], [1, 4]], [[2, 4], [5, 2], [3, 6]], [[1, 2], [3, 4], [7, 3]], [[8, 3], [9, 4], [6, 2]]]


def test_inverted(spark):
    h, f = clean.InvertedIntervals(), frame(spark, INVERTED)
    found = h.check(f)
    assert found["total_inverted"] == 5 and [r.row for r in found["inverted_rows"].collect()] == [1, 2, 3]
    assert cells(h.fix(f, "swap").df)[3] == (3, 8, 4, 9, 2, 6)
    assert h.fix(f, "remove").n_samples == 1
    assert cells(h.fix(f, "set_nan").df)[1] == (2, 4, None, None, 3, 6)
    assert h.fix(f, "ignore") is f
    with pytest.raises(ValueError):
        h.fix(f, "set_equal")
    same = frame(spark, [[[2, 2]], [[None, 1]]])
    assert not h.check(same)["has_inverted"]
    assert "5 inverted" in h.report(f, detailed=True)


MISSING = [[[1, 3], [2, 5]], [[None, None], [3, 6]], [[None, 5], [4, None]], [[4, None], [5, 8]]]


def test_missing(spark):
    h, f = clean.MissingIntervals(), frame(spark, MISSING)
    found = h.check(f)
    assert found["missing_by_feature"] == {"f0": 3, "f1": 1} and clean.has_missing(f)
    assert sorted(r.missing_type for r in found["missing_details"].collect()) == ["both", "lower", "upper", "upper"]
    assert h.fix(f).n_samples == 1
    assert cells(h.fix(f, "fill_mean").df)[1][:2] == (2.5, 4.0)
    assert cells(h.fix(f, "fill_mode").df)[1][:2] == (1.0, 3.0)
    assert cells(h.fix(f, "fill_forward").df)[2] == (1, 5, 4, 6)
    assert cells(h.fix(f, "fill_backward").df)[1] == (4, 5, 3, 6)
    assert cells(h.fix(f, "fill_custom", 9).df)[3] == (4, 9, 5, 8)
    with pytest.raises(ValueError):
        h.fix(f, "fill_custom")
    joint = cells(clean.impute_jointly(f).df)
    assert joint[1][:2] == (1, 3) and joint[2][:2] == (3, 5) and joint[3][:2] == (4, 6) and joint[2][2] == 4
    assert clean.impute_jointly(f, "knn") is f and clean.impute_jointly(f, "remove").n_samples == 1


NORMAL = [[[1, 3], [10, 15]], [[2, 6], [12, 14]], [[5, 8], [8, 16]], [[4, 7], [5, 10]], [[0, 2], [20, 25]]]


@pytest.mark.parametrize("make", [normalize.MinMax, normalize.ZScore, normalize.MidpointWidth])
def test_normalisers_invert(spark, make):
    f = frame(spark, NORMAL)
    n = make()
    with pytest.raises(RuntimeError):
        n.transform(f)
    back = n.inverse_transform(n.fit_transform(f))
    for got, want in zip(cells(back.df), cells(f.df)):
        assert got == pytest.approx(want)
    assert n.parameters(spark).count() == 2 and "f0" in n.report()


def test_normaliser_values(spark):
    f = frame(spark, NORMAL)
    x = cells(normalize.MinMax().fit_transform(f).df)
    assert min(r[0] for r in x) == 0 and max(r[1] for r in x) == 1
    constant = frame(spark, [[[5, 5]], [[None, 5]]])
    assert cells(normalize.MinMax((2, 3)).fit_transform(constant).df) == [(2, 2), (2, 2)]
    z = cells(normalize.ZScore().fit_transform(f).df)
    assert sum(r[0] + r[1] for r in z) == pytest.approx(0)
    one = cells(normalize.ZScore().fit_transform(frame(spark, [[[1, 3]]])).df)
    assert one == [(None, None)]
    q = cells(normalize.RobustQuantile().fit_transform(f).df)
    assert all(0 <= v <= 1 for r in q for v in r)


def test_fill_across_ranges(spark):
    """Values cross the ranges that are filled on their own; all-null ranges, ends and other keys too."""
    import random

    from spanforge.operators.frame import IntervalFrame

    rng = random.Random(3)
    rows = [(k, float(k) if rng.random() < 0.05 and k > 40 else None, 1.0 if k in (100, 101) else None) for k in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "row_id long, x_lower double, x_upper double").repartition(5)
    ordered = sorted(rows)
    for action, order in (("fill_forward", ordered), ("fill_backward", ordered[::-1])):
        want, last = {}, [None, None]
        for k, *v in order:
            last = [a if a is not None else b for a, b in zip(v, last)]
            want[k] = tuple(last)
        for key in ("long", "string"):
            own = df.withColumn("row_id", F.format_string("%04d", "row_id") if key == "string" else F.col("row_id"))
            got = clean.MissingIntervals().fix(IntervalFrame(own, "row_id"), action).df
            assert got.columns == own.columns and {int(r[0]): tuple(r)[1:] for r in got.collect()} == want
    empty = clean.MissingIntervals().fix(IntervalFrame(df.where("false"), "row_id"), "fill_forward").df
    assert empty.count() == 0
