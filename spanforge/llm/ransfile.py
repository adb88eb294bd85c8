"""Token ids in files of independent rANS blocks.

Static range asymmetric numeral system: one frequency table, counted over all
ids, codes every block. A block's ids go round robin to interleaved lanes, each
a 64-bit state that spills 32-bit words, so that one NumPy operation codes a
whole row of lanes. Every ``CHECKPOINT_ROWS`` rows the lane states and the
stream position are kept: decoding can start at any checkpoint, and a block is
decoded from all of its checkpoints at once. A CRC-32 guards a block's ids,
document ids and lengths. Blocks hold whole documents, so they decode in any
order, in parallel.

Files: ``table`` (the frequencies), ``blocks``, and ``parts`` (the first id of
each partition of blocks; a block's place counts from there).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import drop_written, new_path, parts, text_or_empty, workers
from spanforge.llm.tokens import encoded, encoder

MAGIC = b"SFRANS1\0"
HEAD = struct.Struct("<8sQIIIIQ")  # magic, ids, lanes, bits, rows between checkpoints, checkpoints, words
LOW = np.uint64(1 << 31)
LANES, CHECKPOINT_ROWS, BLOCK_IDS = 2048, 128, 1 << 19
TABLE = "symbol int, frequency long"
BLOCK = "part int, before long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary, checksum long"


def table_bits(symbols: int) -> int:
    return max(12, int(symbols - 1).bit_length() + 2)


def quantised(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies adding up to 2**bits, at least 1 for every id that occurs."""
    counts = np.asarray(counts, dtype=np.int64)
    total, target = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (target / total)).astype(np.int64)), 0)
    gap = target - int(freq.sum())
    order = np.argsort(-counts, kind="stable")
    if gap > 0:
        freq[order[0]] += gap
    while gap < 0:
        for s in order.tolist():
            if freq[s] > 1:
                take = min(int(freq[s]) - 1, -gap, max(1, int(freq[s]) // 8))
                freq[s] -= take
                gap += take
            if not gap:
                break
    return freq


class Coder:
    """Encoder and decoder for one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = bits
        self.freq = np.asarray(freq, dtype=np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.limit = ((LOW >> np.uint64(bits)) << np.uint64(32)) * self.freq
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, dtype=np.int64))

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_ROWS) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n // 64))
        rows, bits = -(-n // lanes), np.uint64(self.bits)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        for r in range(rows - 1, -1, -1):
            sym = ids[r * lanes : (r + 1) * lanes]
            x = state[: len(sym)]
            f = self.freq[sym]
            full = x >= self.limit[sym]
            words.append(x[full].astype(np.uint32))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(sym)] = (q << bits) + (x - q * f) + self.cum[sym]
            if r % every == 0:
                marks.append((r, state.copy()))
        words.reverse()
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        marks.reverse()
        stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
        at = np.array([ends[r] for r, _ in marks], dtype="<u8")
        states = np.concatenate([s for _, s in marks]) if marks else np.zeros(0, np.uint64)
        return HEAD.pack(MAGIC, n, lanes, self.bits, every, len(marks), len(stream)) + at.tobytes() + states.astype("<u8").tobytes() + stream.astype("<u4").tobytes()

    def decode(self, data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first..last-1; starts at the checkpoint before ``first``."""
        magic, n, lanes, bits, every, marks, size = HEAD.unpack_from(data)
        if magic != MAGIC or bits != self.bits:
            raise ValueError("not a block of this table")
        last = n if last is None else min(last, n)
        if first >= last:
            return np.zeros(0, np.uint32)
        at = np.frombuffer(data, "<u8", marks, HEAD.size)
        states = np.frombuffer(data, "<u8", marks * lanes, HEAD.size + 8 * marks)
        stream = np.frombuffer(data, "<u4", size, HEAD.size + 8 * marks * (1 + lanes))
        # Segments from checkpoint to checkpoint; only the block's last one can be cut short.
        lo, hi = first // lanes // every, -(-last // (lanes * every))
        whole = hi if n % (lanes * every) == 0 or hi < marks else hi - 1
        out = np.empty((hi - lo) * every * lanes, np.uint32)
        states, at = states.reshape(marks, lanes), at.astype(np.int64)
        if whole > lo:
            self._walk(states[lo:whole].copy(), at[lo:whole].copy(), stream, out[: (whole - lo) * every * lanes].reshape(whole - lo, every, lanes))
        if whole < hi:
            own = out[(whole - lo) * every * lanes :].reshape(1, every, lanes)
            full = n // lanes - whole * every
            x, pos = self._walk(states[whole:hi].copy(), at[whole:hi].copy(), stream, own[:, :full])
            if n % lanes:
                self._walk(x[:, : n % lanes], pos, stream, own[:, full : full + 1, : n % lanes])
        return out[first - lo * every * lanes : last - lo * every * lanes]

    def _walk(self, x: np.ndarray, pos: np.ndarray, stream: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decodes all segments side by side, a row of each in a step; returns their states and places."""
        mask, shift = np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        for k in range(out.shape[1]):
            slot = x & mask
            sym = self.slots[slot]
            out[:, k] = sym
            x = self.freq[sym] * (x >> shift) + slot - self.cum[sym]
            low = x < LOW
            if low.any():
                n = low.sum(axis=1)
                ends = np.cumsum(n)
                x[low] = (x[low] << np.uint64(32)) | stream[np.repeat(pos - (ends - n), n) + np.arange(ends[-1])]
                pos = pos + n
        return x, pos


_CODERS: dict[int, Coder] = {}


def coder(freq: bytes, bits: int) -> Coder:
    key = zlib.crc32(freq)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(np.frombuffer(freq, "<i8"), bits)
    return _CODERS[key]


#: Bytes of texts that are encoded together: the more, the fewer chunks are looked up again.
TOGETHER = 32 << 20


def gathered(batches):
    """The batches, joined until they hold ``TOGETHER`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TOGETHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


STAGED = "doc_id long, crc long, turn long, n long, ids binary, counts binary"


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Ids of every whole text, and in a last row of each task how often it saw each id (a row has ids or counts).

    ``turn`` numbers the rows; with ``crc`` it orders documents of equal ids.
    """
    from pyspark import TaskContext

    def run(batches):
        turn, kind = TaskContext.get().partitionId() << 33, encoder(tokenizer_path, True).kind
        end, total = np.asarray([end_id], dtype=kind), np.zeros(0, np.int64)
        for batch in gathered(batches):
            data, sizes = [], []
            for got in encoded(batch.column(1), tokenizer_path, True, larger=3):
                data.append(np.append(got, end).tobytes())
                sizes.append(len(got) + 1)
            if not data:
                continue
            seen = np.bincount(np.frombuffer(b"".join(data), kind), minlength=len(total))
            seen[: len(total)] += total
            total = seen
            rows = len(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array(np.arange(turn, turn + rows)), pa.array(sizes, pa.int64()), pa.array(data, pa.binary()), pa.nulls(rows, pa.binary())],
                ["doc_id", "crc", "turn", "n", "ids", "counts"],
            )
            turn += rows
        if len(total):
            none = [pa.nulls(1, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["doc_id", "crc", "turn", "n", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, STAGED)


def counted(staged: DataFrame) -> DataFrame:
    """(symbol, n) over all tasks' counts."""

    def run(batches):
        for batch in batches:
            for c in batch.column(0):
                n = np.frombuffer(c.as_buffer(), "<i8")
                symbols = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int32()), pa.array(n[symbols])], ["symbol", "n"])

    return staged.where("counts is not null").select("counts").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def guard(data: bytes, doc_ids, lengths, before: int) -> int:
    """CRC-32 over a block's ids, document ids (null: the least long), lengths and place."""
    none = -(1 << 63)
    rest = np.array([none if x is None else x for x in doc_ids], "<i8"), np.asarray(lengths, "<i8"), np.array([before], "<i8")
    crc = zlib.crc32(data)
    for x in rest:
        crc = zlib.crc32(x.tobytes(), crc)
    return crc


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> str:
    """Encodes every document and writes ``path``/blocks, ``path``/parts and ``path``/table.

    Blocks stand in ascending order of doc_id (nulls first); documents of equal
    ids go by their ids' checksum, then by their place in the input. Null text
    counts as empty: such a document is its end id alone. An empty table writes
    no blocks. Other columns of ``docs`` are ignored.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    workers(spark)
    probe = encoder(tokenizer_path, True)
    kind, symbols = probe.kind, max(probe.symbols, end_id + 1)
    staged_path = f"{path}/staged"
    tokenised(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(staged_path)
    staged = spark.read.schema(STAGED).parquet(staged_path)
    counts = np.zeros(symbols, np.int64)
    for r in counted(staged).collect():  # at most one row per vocabulary entry
        counts[r.symbol] = r.n
    bits = table_bits(symbols)
    freq = quantised(counts, bits)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f], TABLE).coalesce(1).write.parquet(f"{path}/table")
    table = freq.astype("<i8").tobytes()

    def run(batches):
        code, part, before = coder(table, bits), TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def block():
            data = code.encode(np.frombuffer(b"".join(h[2] for h in held), kind))
            doc_ids, lengths = [h[0] for h in held], [h[1] for h in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([guard(data, doc_ids, lengths, before)], pa.int64())],
                ["part", "before", "n_ids", "doc_ids", "doc_lengths", "payload", "checksum"],
            )

        for batch in batches:
            for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if held and size + n > BLOCK_IDS:
                    yield block()
                    held, before, size = [], before + size, 0
                held.append((doc_id, n, data.as_py()))
                size += n
        if held:
            yield block()

    order = ["doc_id", "crc", "turn"]
    ordered = staged.where("ids is not null").select(*order, "n", "ids").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "n", "ids").mapInArrow(run, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    sums = spark.read.schema(BLOCK).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per partition
    ahead, rows = 0, []
    for r in sums:
        rows.append((r.part, ahead))
        ahead += r.n
    spark.createDataFrame(rows, "part int, first_id long").coalesce(1).write.parquet(f"{path}/parts")
    drop_written(spark, staged_path)
    return path


def read_table(spark: SparkSession, path: str) -> tuple[bytes, int]:
    rows = spark.read.parquet(f"{path}/table").collect()  # vocabulary-sized
    freq = np.zeros(max([0, *(r.symbol for r in rows)]) + 1, np.int64)
    for r in rows:
        freq[r.symbol] = r.frequency
    return freq.astype("<i8").tobytes(), int(freq.sum()).bit_length() - 1


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files."""
    workers(spark)
    table, bits = read_table(spark, path)
    first = {r.part: r.first_id for r in spark.read.schema("part int, first_id long").parquet(f"{path}/parts").collect()}  # one row per partition

    def run(batches):
        for batch in batches:
            for part, before, doc_ids, lengths, data, checksum in zip(*(c.to_pylist() for c in batch.columns)):
                if guard(data, doc_ids, lengths, before) != checksum:
                    raise ValueError(f"block at {before} of part {part} is damaged")
                ids = coder(table, bits).decode(data).astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                start = first[part] + before + ends - np.asarray(lengths)
                cut = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").select("part", "before", "doc_ids", "doc_lengths", "payload", "checksum").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the files into the shared folder and digests what they hold."""
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, tokenizer_path, end_id, new_path(spark, "token-ids"))).drop("ids")
