"""Exact removal of repeated 50-byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Suffix-sorting the corpus as a whole would need its
text in one place, so strings are first routed: every window has a minimiser
(the smallest hash of its ``GRAM``-byte grams), equal windows have equal ones,
and maximal runs of windows that share theirs make short pieces of text.

1. Minimisers that only one document holds are sifted out.
2. Pieces with the others go to their minimiser's shard, each once per document
   bucket with the smallest id there.
3. In a shard, equal pieces of several buckets are folded, byte by byte. A piece
   that then stands alone under its minimiser has no windows in common with
   others. Of the rest, windows whose hash no other has are sifted out, which
   loses none that repeat. What is left is cut into blocks; each block gets its
   BWT, and the BWTs are merged by interleave refinement: round p turns the
   order by p - 1 symbols into that by p symbols with one stable counting pass
   over the BWT symbols, carrying along where common prefixes end. After
   ``LENGTH`` rounds the intervals with a longer common prefix are the repeated
   strings; each takes the smallest id in it.
4. Answers go back to the document buckets, which mark and remove bytes.

Payloads are compressed column blobs; one task holds a bucket or shard, whose
size is set by ``BUCKET_BYTES`` and which a frequent string enters once per
bucket, not once per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import text_or_empty, workers, written

LENGTH, GRAM = 50, 16
#: Windows a piece has at most, so that its first and last window cover it.
PIECE_WINDOWS = 48
BUCKET_BYTES = 16 << 20
#: Text that is hashed at once; longer documents are cut, with LENGTH - 1 bytes of overlap.
CHUNK = 1 << 16
#: Symbols of one shard BWT, and of the shards that are merged together.
SHARD, MERGED = 1 << 18, 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
NO_ID = np.iinfo(np.int64).max


def mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)


_LETTER = _letters()


def gram_hashes(b: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, a polynomial in random letters over that many bytes from every position, by doubling."""
    out: list = [None] * len(sizes)
    done = [0] * len(sizes)
    cur, size, power = _LETTER[b], 1, _M1
    while True:
        for i, k in enumerate(sizes):
            if k & size:
                seg = cur[done[i] :]
                if out[i] is None:
                    out[i] = seg
                else:
                    out[i] = out[i][: len(seg)] * power
                    out[i] += seg
                done[i] += size
        size *= 2
        if size > max(sizes):
            return [o[: max(0, len(b) - k + 1)] for o, k in zip(out, sizes)]
        nxt = cur[: max(0, len(cur) - size // 2)] * power
        nxt += cur[size // 2 :]
        cur = nxt
        with np.errstate(over="ignore"):
            power = power * power


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def pieces(texts: list[bytes]):
    """Yields (buffer, owner, at, start, windows, minimiser, key) per chunk of texts.

    owner: index of the text; at: place in the buffer; start: place in the text.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for lo in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            part = t[lo : lo + CHUNK + LENGTH - 1]
            held.append((i, lo, part))
            size += len(part)
            if size >= CHUNK:
                yield _pieces(held)
                held, size = [], 0
    if held:
        yield _pieces(held)


def _pieces(held):
    buf = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    firsts = np.cumsum(sizes) - sizes
    grams, whole = gram_hashes(buf, (GRAM, LENGTH))
    low = least_of(mix(grams), LENGTH - GRAM + 1)
    n = len(low)
    part = np.repeat(np.arange(len(held)), sizes)[:n]
    ok = np.arange(n) + LENGTH <= (firsts + sizes)[part]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (part[1:] != part[:-1])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], n)
    # Windows that would run over the end of a text stand at its end.
    stop = np.minimum(stop, (firsts + sizes)[part[begin]] - LENGTH + 1)
    some = ok[begin] & (stop > begin)
    begin, stop = begin[some], stop[some]
    cuts = -(-(stop - begin) // PIECE_WINDOWS)
    at = np.repeat(begin, cuts) + PIECE_WINDOWS * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    windows = np.minimum(PIECE_WINDOWS, np.repeat(stop, cuts) - at)
    key = mix(mix(whole[at] + windows.astype(np.uint64) * _GOLD) + whole[at + windows - 1] * _M1)
    part = part[at]
    owner = np.array([i for i, _, _ in held])[part]
    start = at - firsts[part] + np.array([lo for _, lo, _ in held])[part]
    return buf, owner, at, start, windows, low[at], key


# Blobs ---------------------------------------------------------------------


def blob(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed; equal high bytes cost next to nothing."""
    out = [np.array([len(columns)], "<i8").tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c)
        planes = c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() if len(c) else b""
        packed = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out += [np.array([len(c), ord(c.dtype.kind), c.itemsize, len(packed)], "<i8").tobytes(), packed]
    return b"".join(out)


def unblob(data: bytes) -> list[np.ndarray]:
    at, out = 8, []
    for _ in range(int(np.frombuffer(data, "<i8", 1)[0])):
        n, kind, size, packed = np.frombuffer(data, "<i8", 4, at).tolist()
        at += 32
        if n:
            planes = pa.decompress(data[at : at + packed], n * size, codec="zstd", asbytes=True)
            out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(f"<{chr(kind)}{size}").reshape(n))
        else:
            out.append(np.zeros(0, f"<{chr(kind)}{size}"))
        at += packed
    return out


def _gathered(blobs, columns: int) -> list[np.ndarray]:
    rows = [unblob(b) for b in blobs]
    if not rows:
        return [np.zeros(0, np.uint64)] * columns
    return [np.concatenate([r[k] for r in rows]) for k in range(columns)]


def _keyed_rows(key: np.ndarray, *columns: np.ndarray):
    """(key, blob) for each key; keys in ascending order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(key)]):
        yield int(key[lo]), blob(*(c[order[lo:hi]] for c in columns))


def document_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) + _GOLD) % np.uint64(n)).astype(np.int64)


def sift_key(low: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of a minimiser, and what tells it from others there."""
    return ((low & np.uint64(0xFFFFFF)) % np.uint64(shards)).astype(np.int64), low >> np.uint64(24)


def _ids(column) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


def _texts(column) -> list[bytes]:
    return [x.as_py() or b"" for x in column]


# Stages --------------------------------------------------------------------

PASSED, WANTED = 0, 1


def sifted(docs: DataFrame, n: int) -> DataFrame:
    """(bucket, data): for each document bucket the sift keys that two documents or more hold."""

    def emit(batches):
        parts = []
        for batch in batches:
            ids, texts = _ids(batch.column(0)), _texts(batch.column(1))
            for _, owner, _, _, _, low, _ in pieces(texts):
                parts.append((low, ids[owner]))
        if not parts:
            return
        h, d = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        fresh = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
        h, d = h[fresh], d[fresh]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        several = np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first)
        shard, sub = sift_key(h[first], n)
        keys, data, kinds = [], [], []
        one = ~several
        # A minimiser of one document here: its id goes along, to be told the outcome.
        for k, b in _keyed_rows(shard[one], sub[one], d[first][one]):
            keys.append(k), data.append(b), kinds.append(WANTED)
        # Of several: kept for sure. The shard learns of it, the documents' buckets directly.
        for k, b in _keyed_rows(shard[several], sub[several]):
            keys.append(k), data.append(b), kinds.append(PASSED)
        sure = np.repeat(several, np.diff(np.append(first, len(h))))
        bucket = document_bucket(d[sure], n)
        where, what = sift_key(h[sure], n)
        for k, b in _keyed_rows(bucket, (where.astype(np.uint64) << np.uint64(40)) | what):
            keys.append(k), data.append(b), kinds.append(2)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["shard", "kind", "data"])

    def settle(t: pa.Table) -> pa.Table:
        shard, kind = t.column("shard")[0].as_py(), t.column("kind").to_numpy()
        blobs = t.column("data").to_pylist()
        sub, ids = _gathered([b for b, k in zip(blobs, kind) if k == WANTED], 2)
        (sure,) = _gathered([b for b, k in zip(blobs, kind) if k == PASSED], 1)
        keys, data = [], []
        if len(sub):
            order = np.argsort(sub, kind="stable")
            sub, ids = sub[order], ids[order]
            first = np.flatnonzero(np.append(True, sub[1:] != sub[:-1]))
            kept = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) | np.isin(sub[first], sure)
            kept = np.repeat(kept, np.diff(np.append(first, len(sub))))
            for k, b in _keyed_rows(document_bucket(ids[kept], n), (np.uint64(shard) << np.uint64(40)) | sub[kept]):
                keys.append(k), data.append(b)
        for b, k in zip(blobs, kind):
            if k == 2:
                keys.append(shard), data.append(b)
        return pa.table({"bucket": pa.array(keys, pa.int64()), "data": pa.array(data, pa.binary())})

    return docs.mapInArrow(emit, "shard long, kind int, data binary").groupBy("shard").applyInArrow(settle, "bucket long, data binary")


def bucketed_texts(docs: DataFrame, n: int) -> DataFrame:
    """(bucket, ids, nulls, sizes, texts): documents dealt to their buckets, packed and compressed."""

    def run(batches):
        for batch in batches:
            ids, texts = _ids(batch.column(0)), _texts(batch.column(1))
            bucket = document_bucket(ids, n)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
            keys, data = [], []
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
                rows = order[lo:hi]
                own = [texts[i] for i in rows]
                keys.append(int(bucket[rows[0]]))
                data.append(blob(ids[rows], np.array([len(x) for x in own], np.int64), np.frombuffer(b"".join(own), np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])

    return docs.mapInArrow(run, "bucket long, data binary")


def _unpacked(t: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    ids, texts = [], []
    for b in t.column("data"):
        some, sizes, body = unblob(b.as_py())
        ids.append(some)
        body, ends = body.tobytes(), np.cumsum(sizes).tolist()
        texts += [body[e - s : e] for e, s in zip(ends, sizes.tolist())]
    return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), texts


def shared_pieces(texts: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """(shard, bucket, data): each piece with a shared minimiser, once per bucket, with its smallest id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, docs = _unpacked(left)
        (known,) = _gathered(right.column("data").to_pylist(), 1)
        out: list[tuple] = []
        if len(ids) and len(known):
            known = np.unique(known)
            bucket = left.column("bucket")[0].as_py()
            for buf, owner, at, _, windows, low, key in pieces(docs):
                shard, sub = sift_key(low, n)
                k = (shard.astype(np.uint64) << np.uint64(40)) | sub
                place = np.minimum(np.searchsorted(known, k), len(known) - 1)
                hit = np.flatnonzero(known[place] == k)
                sizes = windows[hit] + LENGTH - 1
                # Of equal pieces in the chunk one keeps its text.
                order = np.lexsort((ids[owner[hit]], key[hit]))
                hit, sizes = hit[order], sizes[order]
                first = np.flatnonzero(np.append(True, key[hit][1:] != key[hit][:-1])) if len(hit) else np.zeros(0, int)
                if not len(first):
                    continue
                least = ids[owner[hit]][first]
                most = np.maximum.reduceat(ids[owner[hit]], first)
                hit, sizes = hit[first], sizes[first]
                spread = np.repeat(at[hit], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                out.append((shard[hit], low[hit], key[hit], windows[hit].astype(np.uint8), least, most, sizes, buf[spread]))
        rows = {"shard": [], "bucket": [], "data": []}
        if out:
            shard, low, key, windows, least, most, sizes = (np.concatenate([o[k] for o in out]) for k in range(7))
            body = np.concatenate([o[7] for o in out])
            begins = np.cumsum(sizes) - sizes
            order = np.lexsort((least, key, shard))
            fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (shard[order][1:] != shard[order][:-1]))
            first = np.flatnonzero(fresh)
            most = np.maximum.reduceat(most[order], first)
            keep = order[first]
            where = shard[keep]
            edges = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(keep)]):
                own = keep[lo:hi]
                s = sizes[own]
                spread = np.repeat(begins[own], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                rows["shard"].append(int(where[lo]))
                rows["bucket"].append(bucket)
                rows["data"].append(blob(low[own], key[own], windows[own], least[own], most[lo:hi] != least[own], body[spread]))
        return pa.table({"shard": pa.array(rows["shard"], pa.int64()), "bucket": pa.array(rows["bucket"], pa.int64()), "data": pa.array(rows["data"], pa.binary())})

    return texts.groupBy("bucket").cogroup(keys.groupBy("bucket")).applyInArrow(run, "shard long, bucket long, data binary")


# Burrows-Wheeler transforms --------------------------------------------------


def shard_bwt(symbols: np.ndarray, ends: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by ``depth`` symbols or up to their terminator, and the BWT.

    symbols: strings joined, each closed by the terminator 0; ends: their
    terminators' places. Terminators count as different, in the order of strings.
    """
    n = len(symbols)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step, top = 1, len(ends) + (1 << 9)
    order = None
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        both = rank * (top + 2) + after
        order = np.argsort(both, kind="stable")
        s = both[order]
        fresh = np.append(True, s[1:] != s[:-1])
        place = np.cumsum(fresh) - 1
        rank = np.empty(n, np.int64)
        rank[order] = place
        step *= 2
        top = int(place[-1]) + 1
        if step >= depth or top == n:
            break
    before = np.zeros(n, symbols.dtype)
    before[1:] = symbols[:-1]
    before[np.append(0, ends[:-1] + 1)] = 0
    return order, before[order]


def merged_intervals(bwts: list[np.ndarray], strings: list[int], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the transforms after ``depth`` rounds: the shard at each place of the
    merged order, and the number of its interval (a common prefix of ``depth`` symbols)."""
    sizes = [len(b) for b in bwts]
    small = np.uint8 if len(bwts) <= 256 else np.uint16  # counting passes over bytes are the cheapest
    names = np.arange(len(bwts), dtype=small)
    shard, ends = np.repeat(names, sizes), np.repeat(names, strings)
    flat = np.concatenate(bwts)
    interval = np.zeros(sum(sizes), np.int32)
    symbol = np.empty(len(flat), flat.dtype)
    fresh = np.ones(len(flat), bool)
    for _ in range(depth):
        symbol[np.argsort(shard, kind="stable")] = flat  # each transform in its own order
        order = np.argsort(symbol, kind="stable")
        s, old = symbol[order], interval[order]
        np.not_equal(old[1:], old[:-1], out=fresh[1:])
        fresh[1:] |= s[1:] != s[:-1]
        fresh[: len(ends)] = True
        np.cumsum(fresh, out=interval)
        shard = shard[order]
        shard[: len(ends)] = ends  # terminators stay in the order of shards
    return shard, interval


def window_intervals(body: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The interval of every window of every string (strings in order, windows in order): equal windows, equal intervals."""
    closed = sizes + 1
    begins = np.cumsum(closed) - closed
    used = np.bincount(body, minlength=256) > 0
    code = np.cumsum(used).astype(np.uint8 if used.sum() < 256 else np.uint16)  # the order of bytes, from 1 on
    symbols = np.zeros(int(closed.sum()), code.dtype)
    symbols[np.repeat(begins, sizes) + _steps(sizes)] = code[body]
    # Shards of whole strings.
    shard_of = (begins // SHARD).astype(np.int64)
    edges = np.flatnonzero(np.append(True, shard_of[1:] != shard_of[:-1]))
    bwts, orders, counts, offsets = [], [], [], []
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(sizes)]):
        a, b = int(begins[lo]), int(begins[hi - 1] + closed[hi - 1])
        order, bwt = shard_bwt(symbols[a:b], begins[lo:hi] + sizes[lo:hi] - a)
        bwts.append(bwt)
        orders.append(order)
        counts.append(hi - lo)
        offsets.append(a)
    shard, interval = merged_intervals(bwts, counts)
    place = np.empty(len(symbols), np.int64)
    place[np.concatenate([o + a for o, a in zip(orders, offsets)])] = np.argsort(shard, kind="stable")
    return interval[place[np.repeat(begins, windows) + _steps(windows)]]


def least_ids(body: np.ndarray, sizes: np.ndarray, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of every window of every string."""
    of = window_intervals(body, sizes, windows)
    low = np.full(int(of.max()) + 1, NO_ID)
    np.minimum.at(low, of, np.repeat(ids, windows))
    return low[of]


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of ``counts``."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _cut_out(body: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return body[np.repeat(at, sizes) + _steps(sizes)]


def _folded(body: np.ndarray, at: np.ndarray, w: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, of): one string of every set of equal ones that lie in one stretch of ``MERGED`` symbols, and each string's place among them.

    Strings of at most ``PIECE_WINDOWS`` windows are equal if their first and
    last windows stand in the same intervals, which cover them.
    """
    size = w + LENGTH - 1
    stretch = (np.cumsum(size + 1) - 1) // MERGED
    edges = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
    heads, of = [], np.empty(len(w), np.int64)
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(w)]):
        n = w[lo:hi]
        interval = window_intervals(_cut_out(body, at[lo:hi], size[lo:hi]), size[lo:hi], n)
        last = np.cumsum(n) - 1
        one, two = interval[last - n + 1], interval[last]
        order = np.lexsort((ids[lo:hi], two, one, n))
        same = (n[order][1:] == n[order][:-1]) & (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        fresh = np.append(True, ~same)
        of[lo + order] = sum(map(len, heads)) + np.cumsum(fresh) - 1
        heads.append(lo + order[fresh])
    return np.concatenate(heads), of


def _decided(body: np.ndarray, at: np.ndarray, w: np.ndarray, ids: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """The smallest id of every window of the strings at ``at``, by merged transforms; ``lows`` ascends.

    Equal windows have equal minimisers, so whole minimisers are merged at a
    time. One with more than ``MERGED`` symbols is merged in stretches first,
    each of which keeps one of its equal strings, until that helps no more.
    """
    size, out = w + LENGTH - 1, np.empty(int(w.sum()), np.int64)
    first = np.cumsum(w) - w
    lead = np.flatnonzero(np.append(True, lows[1:] != lows[:-1]))
    weight = np.add.reduceat(size + 1, lead)
    turn, hot = (np.cumsum(weight) - 1) // MERGED, weight > MERGED
    edges = lead[np.append(True, (turn[1:] != turn[:-1]) | hot[1:] | hot[:-1])]
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(w)]):
        n, span = w[lo:hi], size[lo:hi]
        here = slice(int(first[lo]), int(first[hi - 1] + w[hi - 1]))
        if (span + 1).sum() > MERGED and lows[lo] == lows[hi - 1]:
            heads, of = _folded(body, at[lo:hi], n, ids[lo:hi])
            if len(heads) <= 0.9 * len(n):
                got = _decided(body, at[lo + heads], n[heads], ids[lo + heads], lows[lo + heads])
                begin = np.cumsum(n[heads]) - n[heads]
                out[here] = got[np.repeat(begin[of], n) + _steps(n)]
                continue
        out[here] = least_ids(_cut_out(body, at[lo:hi], span), span, n, ids[lo:hi])
    return out


def _equal(body: np.ndarray, at: np.ndarray, w: np.ndarray, ids: np.ndarray, lows: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, of): of equal strings under one minimiser the one with the smallest id, and each string's place among these heads.

    ``names`` (equal for equal strings) propose; a string joins a head only if all their bytes agree.
    """
    order = np.lexsort((ids, names, lows))
    fresh = np.append(True, (names[order][1:] != names[order][:-1]) | (lows[order][1:] != lows[order][:-1]))
    head = np.empty(len(w), np.int64)
    head[order] = order[fresh][np.cumsum(fresh) - 1]
    copies = np.flatnonzero(head != np.arange(len(w)))
    differ = w[copies] != w[head[copies]]
    head[copies[differ]] = copies[differ]
    copies = copies[~differ]
    for lo in range(0, len(copies), 4096):
        some = copies[lo : lo + 4096]
        n = w[some] + LENGTH - 1
        same = np.logical_and.reduceat(_cut_out(body, at[some], n) == _cut_out(body, at[head[some]], n), np.cumsum(n) - n)
        head[some[~same]] = some[~same]
    heads = np.flatnonzero(head == np.arange(len(w)))
    return heads, np.searchsorted(heads, head)


def _mixed(body: np.ndarray, begins: np.ndarray, wins: np.ndarray, ids: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """The smallest id of every window of pieces whose minimisers have several pieces.

    Windows whose hash no other has are single and keep their piece's id; the
    hash decides nothing else. Merged transforms decide all others.
    """
    owner = np.repeat(np.arange(len(wins)), wins)
    source = np.repeat(begins, wins) + _steps(wins)
    answer = ids[owner]
    hashes = np.empty(len(source), np.uint64)
    ends = np.cumsum(wins)
    for lo in range(0, len(wins), 4096):
        hi = min(lo + 4096, len(wins))
        size = wins[lo:hi] + LENGTH - 1
        (h,) = gram_hashes(_cut_out(body, begins[lo:hi], size), (LENGTH,))
        hashes[ends[lo] - wins[lo] : ends[hi - 1]] = h[np.repeat(np.cumsum(size) - size, wins[lo:hi]) + _steps(wins[lo:hi])]
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    if not shared.any():
        return answer
    turn = np.append(True, (owner[1:] != owner[:-1]) | (shared[1:] != shared[:-1]))
    b = np.flatnonzero(turn & shared)
    width = np.flatnonzero(np.append(turn[1:], True) & shared) - b + 1
    at, own, low = source[b], ids[owner[b]], lows[owner[b]]
    heads, of = _equal(body, at, width, own, low, mix(hashes[b] + width.astype(np.uint64) * _GOLD) + hashes[b + width - 1] * _M1)
    got = _decided(body, at[heads], width[heads], own[heads], low[heads])
    begin = np.cumsum(width[heads]) - width[heads]
    answer[np.repeat(b, width) + _steps(width)] = got[np.repeat(begin[of], width) + _steps(width)]
    return answer


def _same_bytes(body: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether the strings at ``one`` equal those at ``two``."""
    for lo in range(0, len(sizes), 4096):
        n = sizes[lo : lo + 4096]
        if not np.array_equal(_cut_out(body, one[lo : lo + 4096], n), _cut_out(body, two[lo : lo + 4096], n)):
            return False
    return True


def answered(shared: DataFrame) -> DataFrame:
    """(bucket, data): for pieces of a bucket, the smallest id of each of their windows, as runs."""

    def run(t: pa.Table) -> pa.Table:
        buckets = t.column("bucket").to_pylist()
        rows = [unblob(b.as_py()) for b in t.column("data")]
        low, key, windows, least, several = (np.concatenate([r[k] for r in rows]) for k in range(5))
        windows = windows.astype(np.int64)
        bucket = np.repeat(np.array(buckets, np.int64), [len(r[0]) for r in rows])
        sizes = windows + LENGTH - 1
        body = np.concatenate([r[5] for r in rows])
        begins = np.cumsum(sizes) - sizes
        order = np.lexsort((least, key, low))
        k = key[order]
        same_low = np.append(False, low[order][1:] == low[order][:-1])
        fresh = ~(same_low & np.append(False, k[1:] == k[:-1]))
        piece = np.empty(len(key), np.int64)
        piece[order] = np.cumsum(fresh) - 1
        head = order[fresh]  # the occurrence with the smallest id
        copies = np.flatnonzero(head[piece] != np.arange(len(key)))
        heads = head[piece[copies]]
        if not (np.array_equal(windows[copies], windows[heads]) and _same_bytes(body, begins[copies], begins[heads], sizes[copies])):
            raise ValueError("two different pieces of text have one minimiser and one key")
        ids, wins, lows = least[head], windows[head], low[head]
        first = np.flatnonzero(np.append(True, lows[1:] != lows[:-1]))
        group = np.cumsum(np.append(True, lows[1:] != lows[:-1])) - 1
        alone = np.diff(np.append(first, len(lows)))[group] == 1
        ends = np.cumsum(wins)
        answer = np.repeat(ids, wins)
        mixed = np.flatnonzero(~alone)
        if len(mixed):
            at = np.repeat(ends[mixed] - wins[mixed], wins[mixed]) + _steps(wins[mixed])
            answer[at] = _mixed(body, begins[head[mixed]], wins[mixed], ids[mixed], lows[mixed])
        # Runs of equal answers within a piece.
        owner = np.repeat(np.arange(len(head)), wins)
        turn = np.append(True, (answer[1:] != answer[:-1]) | (owner[1:] != owner[:-1]))
        at = np.flatnonzero(turn)
        run_owner, run_id = owner[at], answer[at]
        run_off = at - (ends - wins)[run_owner]
        run_first = np.searchsorted(run_owner, np.arange(len(head) + 1))
        lowest = np.minimum.reduceat(answer, ends - wins)
        # A bucket needs the answer if a smaller id exists for any of its documents.
        need = several.astype(bool) | (lowest[piece] < least)
        keys, data = [], []
        for b in np.unique(bucket[need]).tolist():
            own = np.flatnonzero(need & (bucket == b))
            p = piece[own]
            n_runs = run_first[p + 1] - run_first[p]
            spread = np.repeat(run_first[p], n_runs) + np.arange(n_runs.sum()) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
            keys.append(b)
            data.append(blob(key[own], n_runs.astype(np.uint8), run_off[spread].astype(np.uint8), run_id[spread]))
        return pa.table({"bucket": pa.array(keys, pa.int64()), "data": pa.array(data, pa.binary())})

    return shared.groupBy("shard").applyInArrow(run, "bucket long, data binary")


def marked(texts: DataFrame, answers: DataFrame, kept_text: bool) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, docs = _unpacked(left)
        rows = [unblob(b.as_py()) for b in right.column("data")]
        base = np.cumsum([0, *(len(d) + 1 for d in docs)])
        gone = np.zeros(int(base[-1]), np.int32)
        if rows:
            key, n_runs, off, least = (np.concatenate([r[k] for r in rows]) for k in range(4))
            n_runs = n_runs.astype(np.int64)
            first = np.cumsum(n_runs) - n_runs
            order = np.argsort(key, kind="stable")
            known = key[order]
            for _, owner, _, start, windows, _, k in pieces(docs):
                place = np.minimum(np.searchsorted(known, k), len(known) - 1)
                hit = np.flatnonzero(known[place] == k)
                p = order[place[hit]]
                n = n_runs[p]
                spread = np.repeat(first[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                last = np.zeros(len(spread), bool)
                last[np.cumsum(n) - 1] = True
                piece = np.repeat(hit, n)
                lo = off[spread].astype(np.int64)
                hi = np.where(last, windows[piece], np.append(lo[1:], 0))
                cut = np.flatnonzero(least[spread] < ids[owner[piece]])
                at = base[owner[piece[cut]]] + start[piece[cut]]
                np.add.at(gone, at + lo[cut], 1)
                np.add.at(gone, at + hi[cut] + LENGTH - 1, -1)
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for i, d in enumerate(docs):
            kept, removed, spans = d, 0, 0
            own = gone[base[i] : base[i + 1]]
            if own.any():
                m = np.cumsum(own)[:-1] > 0
                removed = int(m.sum())
                spans = int((m & ~np.append(False, m[:-1])).sum())
                kept = np.frombuffer(d, np.uint8)[~m].tobytes()
            row = (None if ids[i] == NO_ID else int(ids[i]), len(d), removed, spans, hashlib.sha256(kept).hexdigest(), kept if kept_text else None)
            for c, v in zip(out, row):
                out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    return texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def removed(docs: DataFrame, kept_text: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """What is left of every document; see the module.

    Null text counts as empty and stays as it is; so do texts under LENGTH
    bytes. A document without an id counts as the last: it takes nothing from
    others. Documents with equal ids take nothing from each other. An empty
    table gives no rows; other columns are ignored.
    """
    workers(docs.sparkSession)
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    size = flat.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // bucket_bytes))
    keys = written(sifted(flat, n), "sift-keys")
    answers = written(answered(shared_pieces(bucketed_texts(flat, n), keys, n)), "least-ids")
    out = marked(bucketed_texts(flat, n), answers, kept_text)
    return out if kept_text else out.drop("kept")
