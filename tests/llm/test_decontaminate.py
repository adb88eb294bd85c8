import random
import re

from pyspark.sql import functions as F

from spanforge.llm import decontaminate as d
from tests.llm.common import ROWS, SAME, awkward, docs_of, empty, table


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute(docs, items):
    """Best stretch on every diagonal that some mask hits, from the definition."""
    offsets = [sorted(x + y + z for x in (0, 1) for y in (0, a) for z in (0, b)) for a, b in d.MASKS]
    best = {}
    for i, t in docs:
        w = words(t)
        for item, u in items:
            u = words(u)
            for k, o in enumerate(offsets):
                at = {}
                for q in range(len(u) - o[-1]):
                    at.setdefault(tuple(u[q + x] for x in o), []).append(q)
                for p in range(len(w) - o[-1]):
                    for q in at.get(tuple(w[p + x] for x in o), ()):
                        run = top = 0
                        lo = max(0, p - q)
                        for x, y in zip(w[lo : lo + len(u)], u[max(0, q - p) :]):
                            run = max(0, run) + (1 if x == y else -d.MISMATCH)
                            top = max(top, run)
                        if top >= d.MIN_SCORE:
                            best[i, item] = max(top, best.get((i, item), 0))
    return best


def test_planted_overlaps(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    items = [(k, " ".join(fresh(30))) for k in range(12)] + [(50, "only seven words are in this one"), (51, None)]
    docs = []
    for i in range(60):
        w = items[i % 12][1].split()
        for _ in range(i % 5):
            w[rng.randrange(30)] = "changed"
        cut = w[: rng.randint(6, 30)]
        docs.append((i, " ".join(fresh(rng.randint(0, 40)) + cut + fresh(10))))
    docs += [(100, items[0][1] + ". " + items[0][1].upper() + " " + items[3][1]), (101, items[12][1])] + [(i, t) for i, t in ROWS if i is not None and i not in (3,)]
    docs = [(i + 1000 * k, t) for k, (i, t) in enumerate(docs)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(docs_of(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == brute(docs, items)
    bad = {r.doc_id for r in got}
    assert len(bad) > 20
    kept = d.clean(docs_of(spark, docs), bench)
    assert kept.columns == docs_of(spark, docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_short_items(spark):
    """Items of 8 to 18 words count verbatim, and from 15 words on with two substitutions apart; a few words of them do not."""
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(8, 20)}
    around = lambda w: " ".join(["before", "it", *w, "after", "it"])
    changed = lambda w, *at: [("other" if k in at else x) for k, x in enumerate(w)]
    docs = [(n, around(w)) for n, w in items.items()]
    docs += [(100 + n, around(changed(items[n], 4, 10))) for n in (15, 16, 17, 18)]
    docs += [(200 + n, around(changed(items[n], 2))) for n in (11, 12)]
    docs += [(300 + n, around(w[:7])) for n, w in items.items()] + [(400 + n, around(items[n][:8])) for n in (15, 17, 19)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in d.contaminated(docs_of(spark, docs), bench).collect()}
    want = {(n, n): n for n in items} | {(100 + n, n): n - 6 for n in (15, 16, 17, 18)} | {(211, 11): 8, (212, 12): 9}
    assert got == want
    assert sorted(r.doc_id for r in d.clean(docs_of(spark, docs), bench).collect()) == sorted(i for i, _ in docs if (i, i % 100) not in want)


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    one = sorted(map(tuple, d.contaminated(docs, bench).collect()))
    kept = sorted(r.doc_id for r in d.clean(docs, bench).collect())
    monkeypatch.setattr(d, "BROADCAST_HITS", 0)
    assert sorted(map(tuple, d.contaminated(docs, bench).collect())) == one
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == kept
    monkeypatch.setattr(d, "BROADCAST_SEEDS", 0)
    assert sorted(map(tuple, d.contaminated(docs, bench).collect())) == one


def test_sieve_lets_all_seeds_through(spark, monkeypatch):
    monkeypatch.setattr(d, "SIEVE_WORDS", 1 << 10)
    seeds = spark.range(3000).selectExpr("xxhash64(id) as seed")
    rows = spark.range(200_000).selectExpr("id", "xxhash64(id) as seed")
    got = [r.id for r in d.sieved(rows, seeds).select("id").collect()]
    assert set(range(3000)) <= set(got) and len(got) < 20_000 and len(set(got)) == len(got)


def test_awkward_documents(spark):
    bench = spark.createDataFrame([(1, SAME), (1, SAME), (2, None), (None, "")], "item_id long, text string")
    got = d.contaminated(awkward(spark), bench).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.item_id) for r in got) == [(False, None, 1), (True, 4, 1), (True, 5, 1)]
    assert d.contaminated(empty(spark), bench).count() == 0
    assert d.contaminated(awkward(spark), bench.where("false")).count() == 0
    assert d.clean(awkward(spark), bench).count() == len(ROWS) - 4
    assert d.clean(awkward(spark), bench.where("false")).where(F.col("_text") == -1).count() == len(ROWS)
