import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from spanforge.llm import neardup
from tests.llm.common import ROWS, awkward, docs_of, empty, table, texts


def exact(a, b):
    """Probability Jaccard from its definition."""
    out = 0.0
    for d in set(a) & set(b):
        out += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b))
    return out


def test_exact_similarity():
    rng = random.Random(2)
    for _ in range(60):
        a, b = (Counter(rng.choices(range(12), k=rng.randint(1, 25))) for _ in range(2))
        sets = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
        assert abs(neardup.jp(*sets[0], *sets[1]) - exact(a, b)) < 1e-9


def test_registers_estimate_it():
    rng = np.random.default_rng(4)
    ids = neardup.mix(np.arange(1, 400, dtype=np.uint64))
    wa, wb = rng.integers(0, 4, len(ids)), rng.integers(0, 4, len(ids))
    wb[:250] = wa[:250]
    a, b = np.flatnonzero(wa), np.flatnonzero(wb)
    sig = neardup.signatures(np.concatenate([ids[a], ids[b]]), np.concatenate([wa[a], wb[b]]), np.repeat([0, 1], [len(a), len(b)]), 2, 4096)
    want = exact({i: wa[i] for i in a}, {i: wb[i] for i in b})
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def brute(rows):
    """Classes by comparing every two texts."""
    sets = {t: neardup.shingles(t) for _, t in rows}
    parent = {t: t for t in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if len(x[0]) and len(y[0]) and min(len(x[0]), len(y[0])) > 0.3 * max(len(x[0]), len(y[0])) and neardup.jp(*x, *y) >= neardup.SIMILARITY:
            parent[root(a)] = root(b)
    least = {}
    for i, t in rows:
        least[root(t)] = min(i, least.get(root(t), i))
    return sorted((i, least[root(t)]) for i, t in rows)


def test_classes_on_the_corpus(spark):
    got = neardup.classes(table(spark, "documents")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(texts(spark))
    assert all(r.is_representative == (r.doc_id == r.class_id) for r in got)


def test_large_group_of_near_copies(spark):
    """More classes than the star rounds settle, buckets with many members, and chains of copies."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    got = neardup.classes(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(rows)


def test_different_texts_of_one_id(spark):
    """Each text is judged by itself; none is lost, and texts without an id are told apart."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (3, c), (None, b), (None, c + " end"), (None, None)]
    got = neardup.classes(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.class_id) for r in got} == {(1, 1), (2, 1), (3, 3), (None, 1), (None, 3), (None, None)}
    kept = neardup.deduplicated(docs_of(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (1, b), (3, c), (None, b), (None, c + " end"), (None, None)], key=str)


def test_shingles_are_those_of_the_words():
    rng = random.Random(3)
    many = ["", "a", "İ ça Ünï ΟΔΟΣ οδος", "x " * 50, "\n\n", "İ" * 5, "_ _a 漢字 字"] + ["".join(rng.choices("aB \n_İΣ1é.,", k=rng.randint(0, 80))) for _ in range(300)]
    ids, counts, sizes = neardup.shingle_sets_of(many)
    ends, known = np.cumsum(sizes), {}
    for text, n, end in zip(many, sizes, ends):
        words = re.findall(r"\w+", text.lower())
        want = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
        assert sorted(counts[end - n : end].tolist()) == sorted(want.values())
        alone = neardup.shingles(text)
        assert alone[0].tolist() == ids[end - n : end].tolist() and alone[1].tolist() == counts[end - n : end].tolist()
        if len(want) == 1:
            assert known.setdefault(next(iter(want)), alone[0][0]) == alone[0][0]
    assert len(set(known.values())) == len(known) > 5


def all_pairs(rows):
    """Classes by comparing every two texts, whatever their sizes."""
    sets = {t: neardup.shingles(t) for _, t in rows}
    parent = {t: t for t in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a][0]) and len(sets[b][0]) and neardup.jp(*sets[a], *sets[b]) >= neardup.SIMILARITY:
            parent[root(a)] = root(b)
    least = {}
    for i, t in rows:
        least[root(t)] = min(i, least.get(root(t), i))
    return sorted((i, least[root(t)]) for i, t in rows)


def block(sets):
    """What a task of the block comparison reads of one block: members of one bucket, each a class of its own."""
    names = pa.array([f"n{i:03d}".encode() for i in range(len(sets))], pa.binary())
    raw = lambda k, kind: pa.array([np.asarray(s[k], kind).tobytes() for s in sets], pa.binary())
    zero = pa.array([0] * len(sets), pa.int32())
    return pa.table({"bucket": pa.array([1] * len(sets)), "node": names, "root": names, "mine": zero, "lo": zero, "hi": zero, "keys": pa.array([np.array([1], "<u8").tobytes()] * len(sets), pa.binary()), "ids": raw(0, "<u8"), "counts": raw(1, "<u4")})


def test_block_links_of_repeated_shingles():
    """Pairs whose plain sets share little, but not their weights; and random ones, against every pair."""
    own = lambda k, n: list(range(1000 * k, 1000 * k + n))
    for shared, times, n in ((20, 20, 40), (5, 1000, 50)):
        sets = [([*range(shared), *own(k, n)], [times] * shared + [1] * n) for k in (1, 2)]
        assert exact(*(dict(zip(*s)) for s in sets)) >= neardup.SIMILARITY
        assert neardup._joining_links(block(sets)).num_rows == 1
    rng = np.random.default_rng(5)
    sets = []
    for k in range(60):
        base = rng.permutation(40)[: rng.integers(34, 41)]
        ids = np.sort(np.concatenate([base, own(k + 1, int(rng.integers(0, 60)))])).astype(int)
        sets.append((ids, np.where(ids < 40, rng.choice([1, 8, 9, 30]), 1)))
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if exact(*(dict(zip(*sets[k])) for k in (i, j))) >= neardup.SIMILARITY}
    assert any(len(set(sets[i][0]) & set(sets[j][0])) < 0.4 * len(set(sets[i][0]) | set(sets[j][0])) for i, j in want)
    got = [(int(a[1:]), int(b[1:])) for a, b in zip(*(c.to_pylist() for c in neardup._joining_links(block(sets)).columns))]
    assert set(got) <= want

    def grouped(pairs):
        name = list(range(60))
        for i, j in pairs:
            name = [name[i] if x == name[j] else x for x in name]
        return [name.index(x) for x in name]

    assert grouped(got) == grouped(want)


def test_large_group_with_repeated_lines(spark, monkeypatch):
    """One much repeated line and ends of their own: left to the block comparison, classes stay those of all pairs."""
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 1)
    rng = random.Random(11)
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(i, "\n".join([line] * 25 + [" ".join(f"x{i}y{j}" for j in range(rng.randint(30, 110)))])) for i in range(90)]
    got = neardup.classes(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == all_pairs(rows)


def test_awkward_documents(spark):
    got = neardup.classes(awkward(spark)).collect()
    assert len(got) == len(ROWS)
    of = {r.doc_id: r.class_id for r in got}
    assert of[4] == of[5] == 4 and of[1] == of[2] == of[9] == 1 and of[3] == 3 and of[6] == 6
    kept = neardup.deduplicated(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.select("doc_id").collect()) == sorted((i is not None, i) for i in (None, 1, 3, 4, 6, 7, 8))
    assert neardup.classes(empty(spark)).count() == 0 and neardup.deduplicated(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [(f"b{rng.randrange(40)}", f"c{rng.randrange(40)}") for _ in range(35)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got) == set(parent)
    assert all((got[a] == got[b]) == (root(a) == root(b)) for a, b in itertools.combinations(got, 2))
    assert neardup.components(spark.createDataFrame([], "a string, b string")).count() == 0
