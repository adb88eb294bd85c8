"""Packing of tokenised documents into fixed-length training sequences.

First-fit decreasing, run on its own in each randomised group of pieces; a
tournament tree over the open bins' room finds the first bin that fits in
O(log bins). A document longer than a sequence is cut into whole sequences and
one remainder. Groups are dealt by a hash of (document, piece, row), so a very
long document, source or group of copies spreads over all of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import lean, text_or_empty, workers, written
from spanforge.llm.tokens import encoded

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces a group holds on average: enough for little padding, small for one task.
GROUP_PIECES = 8192


class TournamentTree:
    """Bins in order of opening; inner nodes hold the most room below them."""

    def __init__(self, leaves: int):
        self.size = 1 << max(0, (max(1, leaves) - 1).bit_length())
        self.room = [0] * (2 * self.size)

    def put(self, leaf: int, room: int) -> None:
        tree, i = self.room, leaf + self.size
        tree[i] = room
        i >>= 1
        while i:
            most = tree[2 * i] if tree[2 * i] >= tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == most:
                break
            tree[i] = most
            i >>= 1

    def first(self, need: int) -> int:
        """The first bin with that room, or -1."""
        tree = self.room
        if tree[1] < need:
            return -1
        i = 1
        while i < self.size:
            i *= 2
            if tree[i] < need:
                i += 1
        return i - self.size


def first_fit_decreasing(lengths, capacity: int):
    """Bin and offset of each item; items of equal length go in the given order."""
    lengths = np.asarray(lengths, dtype=np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    whole = int((lengths >= capacity).sum())
    bins[order[:whole]] = np.arange(whole)
    rest, n = order[whole:], 0
    tree = TournamentTree(len(rest))
    for i, need in zip(rest.tolist(), lengths[rest].tolist()):
        b = tree.first(need)
        if b < 0:
            b, n = n, n + 1
            room = capacity
        else:
            room = tree.room[b + tree.size]
        bins[i], offsets[i] = whole + b, capacity - room
        tree.put(b, room - need)
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """One row per piece of at most ``capacity`` ids. Null text: empty, so only the end id."""
    workers(docs.sparkSession)
    end, step = np.asarray([end_id], dtype="<u4"), 4 * capacity

    def run(batches):
        for batch in batches:
            ids, starts, sizes, crcs, totals = [], [], [], [], []
            for doc_id, got in zip(batch.column(0).to_pylist(), encoded(batch.column(1), tokenizer_path, False)):
                data = np.concatenate([got, end], dtype="<u4").tobytes()
                for at in range(0, len(data), step):
                    piece = data[at : at + step]
                    ids.append(doc_id)
                    starts.append(at // 4)
                    sizes.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(len(data) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes, crcs, totals)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lean(run), PIECE)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of (doc_id, start, length, ...).

    Equal rows (a document read twice) are packed as often as they occur; the
    hash that deals rows to groups takes in a number of the row's own, so that
    repeated and null ids spread as well. An empty table gives an empty result.
    Ids are group * 2^32 + bin.
    """
    workers(pieces.sparkSession)
    # Written once, so that row numbers stay what they are when a task is run again.
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "_row", F.lit(seed)), F.lit(groups)))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("_row", "ascending")])
        bins, offsets = first_fit_decreasing(t.column("length").to_numpy(), capacity)
        base = t.column("_group")[0].as_py() << 32
        t = t.drop_columns(["_group", "_row"])
        return t.append_column("sequence_id", pa.array(bins + base, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_row") + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Tokenises and packs whole documents; see :func:`pack_pieces`.

    Null or empty text gives a piece holding only the end id. A null doc_id is
    packed like any other. Further columns of ``docs`` are ignored.
    """
    return pack_pieces(token_pieces(docs, tokenizer_path, end_id, capacity), capacity)
