import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanforge.llm import ransfile, tokens
from spanforge.llm.common import new_path
from spanforge.llm.tokens import encoder
from tests.llm.common import ROWS, awkward, docs_of, empty, texts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "The", "don't", "it's", " ", "  ", "\n", "\t", "\r\n", "1234", "é", "İ", "ß", "漢字", "...", "-", "'", "<|endoftext|>", "<|startoftext|>", " ", "　", "é", "😀", "_x", "Straße", "#$%", "\x00", "​", "CamelCase", "ſ", "K", "…"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=14).map("".join))
def test_encoder_agrees_with_the_library(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    for path, spaced in ((BYTE, True), (WORD, False)):
        want = np.asarray(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if path not in _TOK else _TOK[path].encode(text, add_special_tokens=False).ids).tolist()
        assert encoder(path, spaced).encode(text).tolist() == want


_TOK = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def test_encoder_on_the_corpus(spark):
    for _, t in texts(spark):
        for path, spaced in ((BYTE, True), (WORD, False)):
            assert encoder(path, spaced).encode(t).tolist() == _TOK[path].encode(t, add_special_tokens=False).ids


def test_small_cache_gives_the_same(spark, monkeypatch):
    """Chunks that move between generations, and texts encoded together, alone and in any portion."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(tokens, "PORTION", 3000)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    some = [None, "", *(t for _, t in texts(spark)[:80]), "Été, été; ÉTÉ! x" * 3]
    for path, spaced in ((BYTE, True), (WORD, False)):
        got = [x.tolist() for x in tokens.encoded(pa.array(some), path, spaced)]
        assert got == [_TOK[path].encode(t or "", add_special_tokens=False).ids for t in some]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=900), st.integers(1, 7), st.integers(1, 9))
def test_blocks_round_trip(ids, lanes, every):
    ids = np.asarray(ids, np.uint32)
    code = ransfile.Coder(ransfile.quantised(np.bincount(ids, minlength=41), 12), 12)
    data = code.encode(ids, lanes, every)
    assert (code.decode(data) == ids).all()
    for lo, hi in ((len(ids) // 3, len(ids) // 3 + 50), (0, 1), (len(ids) // 2, len(ids)), (max(0, len(ids) - 1), len(ids))):
        assert (code.decode(data, lo, hi) == ids[lo:hi]).all()  # from checkpoints


def test_quantised_table():
    for counts in ([0, 0], [1], [10**9, 1, 0, 1], [1] * 4000, list(range(5000))):
        f = ransfile.quantised(np.asarray(counts), 13)
        assert f.sum() == (1 << 13 if sum(counts) else 0) and ((f > 0) == (np.asarray(counts) > 0)).all()


def expected(rows):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = _TOK[BYTE].encode(t, add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip_on_the_corpus(spark):
    from tests.llm.common import table

    got = ransfile.round_trip(table(spark, "documents"), BYTE, 2).collect()
    assert sorted(map(tuple, got)) == expected(texts(spark))


def test_awkward_documents(spark):
    got = sorted(map(tuple, ransfile.round_trip(awkward(spark).where("doc_id is not null"), BYTE, 2).collect()))
    want = expected([(i, t or "") for i, t in ROWS if i is not None])
    assert got == want
    assert ransfile.round_trip(awkward(spark), BYTE, 2).count() == len(ROWS)
    assert ransfile.round_trip(empty(spark), BYTE, 2).count() == 0


@pytest.mark.parametrize("column", ["payload", "doc_ids", "doc_lengths", "before"])
def test_damage_is_noticed(spark, column):
    path = ransfile.write_ids(awkward(spark), BYTE, 2, new_path(spark, "damage"))
    rows = [r.asDict() for r in spark.read.parquet(f"{path}/blocks").collect()]
    for r in rows:
        was = r[column]
        r[column] = bytes([*was[:-1], was[-1] ^ 1]) if column == "payload" else was + 1 if column == "before" else [*was[:-1], was[-1] + 1]
    spark.createDataFrame([tuple(r.values()) for r in rows], ransfile.BLOCK).write.parquet(f"{path}-bad/blocks")
    for name in ("table", "parts"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{path}-bad/{name}")
    with pytest.raises(Exception, match="damaged"):
        ransfile.read_ids(spark, f"{path}-bad").count()


def test_equal_ids_spread(spark):
    """Rows of one id and of none go to all partitions, and still stand in one order."""
    rows = [(None, f"none {i}") for i in range(300)] + [(5, f"text {i % 60}") for i in range(300)]
    path = ransfile.write_ids(docs_of(spark, rows).repartition(3), BYTE, 2, new_path(spark, "equal"))
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 2
    got = sorted(ransfile.read_ids(spark, path).drop("ids").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + [5] * 300
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    want = sorted((str(i), zlib.crc32(np.asarray(_TOK[BYTE].encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
