import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanforge.llm import packing
from tests.llm.common import ROWS, awkward, empty, table

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_tree_gives_first_fit_decreasing():
    rng = random.Random(5)
    for _ in range(40):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(0, 300))]
        bins, offsets = packing.first_fit_decreasing(sizes, 64)
        used = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, u in enumerate(used) if u + sizes[i] <= 64), len(used))
            if b == len(used):
                used.append(0)
            assert (bins[i], offsets[i]) == (b, used[b])
            used[b] += sizes[i]


def check(rows, source, capacity=2048):
    tok = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in source:
        want[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    held, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(held) == set(want)
    for i, copies in want.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in held[i])
        expect = []
        for ids in copies:
            at = {s: n for s, n, *_ in pieces}
            s = 0
            while s < len(ids):
                cut = ids[s : s + at[s]]
                expect.append((s, len(cut), zlib.crc32(np.asarray(cut, "<u4").tobytes()), len(ids)))
                s += len(cut)
        assert pieces == sorted(expect)
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_awkward_documents(spark):
    check(packing.pack_documents(awkward(spark), PATH).collect(), ROWS)
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_whole_table_with_little_padding(spark):
    source = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    rows = packing.pack_documents(table(spark, "documents"), PATH).collect()
    n = check(rows, source)
    assert sum(r.length for r in rows) >= 0.97 * 2048 * (n - 1)


@pytest.mark.parametrize("group_pieces", [8, 100])
def test_groups_keep_every_piece(spark, group_pieces):
    df = spark.createDataFrame([(i, 0, 1 + i % 50) for i in range(500)] + [(3, 0, 4)], "doc_id long, start long, length long")
    rows = packing.pack_pieces(df, 64, group_pieces).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted((r.doc_id, r.length) for r in df.collect())
    room = defaultdict(int)
    for r in rows:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 64


def test_repeated_and_null_ids_spread(spark):
    """A group holds about as many pieces as it should, however the ids repeat."""
    df = spark.createDataFrame([(None, 0, 5)] * 400 + [(7, 0, 5)] * 400, "doc_id long, start long, length long")
    rows = packing.pack_pieces(df, 64, 50).collect()
    groups = defaultdict(int)
    for r in rows:
        groups[r.sequence_id >> 32] += 1
    assert len(rows) == 800 and len(groups) == 16 and max(groups.values()) < 100
