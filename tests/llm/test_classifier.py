import numpy as np

from spanforge.llm import classifier
from tests.llm.common import ROWS, awkward, docs_of, empty, labels_of


def test_likelihood_learns_grades():
    rng = np.random.default_rng(1)
    vocab = (["vile", "hate", "awful"], ["spam", "click", "buy"], ["theory", "measured", "result"])
    make = lambda g: " ".join(rng.choice(vocab[g] + ["the", "of", "and", "in", "to"], 40))
    grades = rng.integers(0, 3, 600)
    m = classifier.fit([make(g) for g in grades], grades)
    assert np.all(np.diff(m.thresholds) >= 0)
    p = np.array([m.probabilities(m.score(make(g))) for g in (0, 1, 2) for _ in range(50)])
    assert np.all(np.diff(p, axis=1) <= 1e-12)  # tails fall with the grade
    expected = p.sum(axis=1).reshape(3, 50).mean(axis=1)
    assert expected[0] < 0.5 < expected[1] < 1.5 < expected[2]
    assert (np.abs(p.sum(axis=1).round() - np.repeat([0, 1, 2], 50)) < 1).mean() > 0.9


def test_held_out_accuracy(spark):
    """Trained on half of the labels, tested on the other."""
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet").where("doc_id < 6000")
    docs = spark.read.parquet(f"{base}/documents.parquet").where("doc_id < 6000")
    model = classifier.train(docs, labels.where("doc_id % 2 = 0"))
    rows = classifier.scored(docs, model).join(classifier.graded(labels.where("doc_id % 2 = 1")), "doc_id").collect()
    good = [r.kept for r in rows if r.grade == 2]
    toxic = [r.kept for r in rows if r.grade == 0]
    assert np.mean(good) >= 0.95
    assert np.mean(toxic) <= 0.2


def test_awkward_documents(spark):
    got = classifier.classify(awkward(spark), labels_of(spark)).collect()
    assert len(got) == len(ROWS) and all(r.kept for r in got)  # nothing learnt
    labels = labels_of(spark, [(4, 1, 0), (4, 1, None), (7, 0, 0), (3, None, None), (None, 1, 0), (8, 1, 1)])
    assert sorted(map(tuple, classifier.graded(labels).collect())) == [(4, 2), (7, 1), (8, 0)]
    assert len(classifier.classify(awkward(spark), labels).collect()) == len(ROWS)
    assert classifier.classify(empty(spark), labels).count() == 0


def test_every_text_counts_whole(spark):
    tail = "x " * 50_000
    m = classifier.OrdinalModel(np.zeros(1 << classifier.BITS), np.zeros(classifier.EXTRA), np.array([-1.0, 1.0]))
    at, _, _ = classifier.features("zeppelin")
    m.weights[at[0]] = 1.0
    a, b = classifier.scored(docs_of(spark, [(1, tail), (2, tail + "zeppelin")]), m).orderBy("doc_id").collect()
    assert b.score > a.score == 0


def test_training_reads_whole_texts(spark):
    """What tells the grades apart stands behind a long beginning that all share."""
    start = "the same words again and again " * 800
    docs = [(i, start + ("vile awful", "theory measured")[i % 2]) for i in range(200)]
    model = classifier.train(docs_of(spark, docs, extra=False), labels_of(spark, [(i, i % 2, 1 - i % 2) for i in range(200)]))
    good, bad = (model.probabilities(model.score(docs[i][1]))[-1] for i in (1, 0))
    assert good > 0.8 and bad < 0.2
    # The cutoff is that of whole texts.
    assert bad < model.cutoff <= good


def test_query_against_brute_force(spark):
    """The whole query, against training and scoring in plain Python over lists, word by word."""
    import math
    import re
    import zlib

    from spanforge.llm import queries
    from tests.llm.common import DATA, table

    texts = {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}
    grade = {}
    for r in table(spark, "labels").collect():
        g = 0 if r.toxic == 1 else r.quality + 1 if r.quality is not None else None
        if g is not None and r.doc_id in texts:
            grade[r.doc_id] = min(g, grade.get(r.doc_id, 2))
    assert len(grade) <= classifier.SAMPLE_ROWS  # so the sample is all of them
    ids = sorted(grade, key=lambda i: (zlib.crc32(str(i).encode()), i))
    fitted = [i for k, i in enumerate(ids) if k % 5]
    n = [sum(grade[i] == g for i in fitted) for g in range(3)]
    m = classifier.fit([texts[i] for i in fitted], [grade[i] for i in fitted], [math.sqrt(max(n) / max(x, 1)) for x in n])

    def score(text):
        words = re.findall(r"[^\W\d_]+|[\d]+|[^\w\s]+", text.lower())
        total = 0.0
        for cut in ("{}", "4:{:.4}", "6:{:.6}"):
            seen = {}
            for w in words:
                b = zlib.crc32(cut.format(w).encode()) % (1 << classifier.BITS)
                seen[b] = seen.get(b, 0) + 1
            total += sum(m.weights[b] * (1 + math.log(k)) for b, k in seen.items())
        at, v, dense = classifier.features(text)
        stats = v == 3.0
        stats[: len(v) - int((classifier.STEPS[None, :] <= dense[2:, None]).sum())] = False  # the statistics' bins stand last
        return total + float(m.weights[at[stats]] @ v[stats]) + float(m.dense @ dense)

    tail = lambda s, t: 1 / (1 + math.exp(-max(-40.0, min(40.0, s - t))))
    held = sorted(tail(score(texts[i]), m.thresholds[1]) for k, i in enumerate(ids) if k % 5 == 0 and grade[i] == 2)
    cutoff = min(0.5, float(np.quantile(held, 0.015))) if len(held) >= 20 else 0.5
    got = queries.queries()["op7_quality_classifier"](spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        p = [tail(score(texts[r.doc_id]), t) for t in m.thresholds]
        assert abs(r.p_good - p[1]) < 1e-4 and abs(r.expected_grade - sum(p)) < 2e-4
        assert r.kept == (p[1] >= cutoff) or abs(p[1] - cutoff) < 1e-4


def test_repeated_labelled_rows_teach_once(spark):
    docs = [(i, ("vile awful", "theory measured")[i % 2] + f" w{i % 7}" * 3) for i in range(60)]
    labels = labels_of(spark, [(i, i % 2, 1 - i % 2) for i in range(60)])
    once = classifier.sampled(docs_of(spark, docs), classifier.graded(labels))
    many = classifier.sampled(docs_of(spark, docs * 20 + [(3, "zzz " * 30)]), classifier.graded(labels))
    assert len(once) == len(many) == 60
    assert [a[:2] for a in once] == [b[:2] for b in many]
    a, b = (classifier.fit_features([x for _, _, x in rows], [g for _, g, _ in rows]) for rows in (once, classifier.sampled(docs_of(spark, docs * 20), classifier.graded(labels))))
    assert (a.weights == b.weights).all()


def test_ties_with_the_cutoff_stay(spark):
    m = classifier.OrdinalModel(np.zeros(1 << classifier.BITS), np.zeros(classifier.EXTRA), np.array([-1.0, 0.0]), cutoff=0.5)
    rows = classifier.scored(docs_of(spark, [(1, "any words"), (1, "any words"), (None, None)]), m).collect()
    assert [r.p_good for r in rows] == [0.5] * 3 and all(r.kept for r in rows)
