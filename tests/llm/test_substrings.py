import hashlib
import random

import numpy as np
import pytest

from spanforge.llm import substrings
from tests.llm.common import ROWS, awkward, docs_of, empty, table, texts

L = substrings.LENGTH


def brute(rows):
    least, data = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - L + 1):
            w = b[k : k + L]
            if i < least.get(w, 1 << 62):
                least[w] = i
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - L + 1):
            if least[b[k : k + L]] < i:
                gone[k] += 1
                if k + L < len(gone):
                    gone[k + L] -= 1
        m = np.cumsum(gone)[: len(b)] > 0
        spans = int((m & ~np.append(False, m[:-1])[: len(m)]).sum()) if len(m) else 0
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out.append((i, len(b), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 100_000])
def test_on_the_corpus(spark, bucket_bytes):
    assert found(substrings.removed(table(spark, "documents"), bucket_bytes=bucket_bytes)) == brute(texts(spark))


def test_overlaps_periods_and_frequent_passages(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    common, other = word(130), word(51)
    rows = [(i, word(rng.randint(0, 60)) + common[rng.randint(0, 60) :] + word(9) + other + word(rng.randint(0, 80))) for i in range(60)]
    rows += [(100, "a" * 400), (101, "a" * 49), (102, "b" + "a" * 60), (103, "ab" * 200), (104, "x" * 50 + "y" * 50), (105, "x" * 50), (106, "é" * 30 + "ü" * 40), (107, "z" + "é" * 30)]
    assert found(substrings.removed(docs_of(spark, rows), bucket_bytes=3000)) == brute(rows)


def test_merged_transforms_equal_sorting():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(60, 90))) for _ in range(30)]
    strings += [strings[0][:70], strings[3]]
    sizes = np.array([len(s) for s in strings])
    old, substrings.SHARD = substrings.SHARD, 400
    try:
        got = substrings.least_ids(np.frombuffer(b"".join(strings), np.uint8), sizes, sizes - L + 1, np.arange(len(strings)) * 3)
    finally:
        substrings.SHARD = old
    windows = [(i, s[k : k + L]) for i, s in enumerate(strings) for k in range(len(s) - L + 1)]
    assert got.tolist() == [3 * min(j for j, v in windows if v == w) for _, w in windows]


def test_every_shared_window_is_merged(spark, monkeypatch):
    """Windows that two different pieces hold are decided by transforms, also where a minimiser outgrows one merge."""
    rng = np.random.default_rng(12)
    letters = np.frombuffer(b"abcdefgh ", np.uint8)
    passage = letters[rng.integers(0, 9, 70)]
    parts = [np.concatenate([letters[rng.integers(0, 9, rng.integers(0, 4))], passage[rng.integers(0, 9) : 70 - rng.integers(0, 9)], letters[rng.integers(0, 9, 3)]]) for _ in range(300)]
    body, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
    begins, wins, ids = np.cumsum(sizes) - sizes, sizes - L + 1, rng.permutation(300)
    windows = [bytes(p[k : k + L]) for p, n in zip(parts, wins) for k in range(n)]
    owner = np.repeat(ids, wins)
    least, times = {}, {}
    for i, v in zip(owner.tolist(), windows):
        least[v], times[v] = min(i, least.get(v, i)), times.get(v, 0) + 1
    sent, real = [], substrings.window_intervals

    def counted(body, sizes, windows):
        sent.append(len(body))
        return real(body, sizes, windows)

    monkeypatch.setattr(substrings, "window_intervals", counted)
    monkeypatch.setattr(substrings, "SHARD", 1000)
    for merged, merges in ((1 << 20, 1), (4000, 4)):
        sent.clear()
        monkeypatch.setattr(substrings, "MERGED", merged)
        got = substrings._mixed(body, begins, wins, ids, np.zeros(300, np.uint64))
        assert got.tolist() == [least[v] for v in windows]
        assert len(sent) >= merges and sum(n > 1 for n in times.values()) > 10


def test_pieces_of_one_key_are_compared_by_bytes():
    body = np.frombuffer(b"abcabdabc", np.uint8)
    three = np.array([3])
    assert substrings._same_bytes(body, np.array([0]), np.array([6]), three)
    assert not substrings._same_bytes(body, np.array([0]), np.array([3]), three)


def test_copies_are_merged_once(monkeypatch):
    """Equal strings under one minimiser go into the transforms once, however many, also where a name means different strings."""
    rng = np.random.default_rng(11)
    few = [rng.integers(97, 101, 75, dtype=np.uint8) for _ in range(4)]
    strings = [few[k] for k in rng.integers(0, 4, 400)]
    body, sizes = np.concatenate(strings), np.array([len(x) for x in strings])
    begins, wins, ids = np.cumsum(sizes) - sizes, sizes - L + 1, rng.permutation(400)
    merged, plain = [], substrings.least_ids
    monkeypatch.setattr(substrings, "MERGED", 2000)
    monkeypatch.setattr(substrings, "least_ids", lambda body, *a: merged.append(len(body)) or plain(body, *a))
    want = plain(body, sizes, wins, ids)
    assert (substrings._mixed(body, begins, wins, ids, np.zeros(400, np.uint64)) == want).all()
    assert sum(merged) == 4 * 75
    names = np.zeros(400, np.uint64)  # one name for all
    heads, of = substrings._equal(body, begins, wins, ids, np.zeros(400, np.uint64), names)
    assert all((strings[heads[k]] == x).all() for k, x in zip(of, strings))


def test_awkward_documents(spark):
    rows = [(i, t) for i, t in ROWS if i is not None]
    assert found(substrings.removed(awkward(spark).where("doc_id is not null"))) == brute(rows)
    got = substrings.removed(awkward(spark), kept_text=True).collect()
    assert len(got) == len(ROWS) and [r.n_removed for r in got if r.doc_id is None and r.n_bytes] == [len(ROWS[3][1])]
    assert substrings.removed(empty(spark)).count() == 0
