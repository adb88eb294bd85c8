"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Texts become weighted sets of five-word shingles (weight: how often it occurs).
ProbMinHash lets each shingle's arrivals be a Poisson process whose rate is its
weight; each arrival draws a register, every register keeps its earliest
arrival, and a shingle stops once its next arrival is later than all registers.
Two registers agree with the probability Jaccard similarity J_P. Bands of
registers propose links; a link counts if the exact J_P reaches ``SIMILARITY``.

Equal texts are folded first, so copies cost nothing further. In each bucket
members are compared with one centre; those that do not match it go on to the
next centre among themselves, for ``STAR_ROUNDS`` rounds. Buckets that then
still hold several classes are compared in full, block by block, but only
between classes; such a task returns no more links than join classes.
Classes are the connected components of the verified links.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import cut, lean, text_or_empty, workers, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
STAR_ROUNDS = 3
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Bytes of shingles that a block holds on average at most.
BLOCK_BYTES = 8 << 20
#: Characters that are hashed at once, and arrivals that are drawn at once.
CHARS, ARRIVALS = 1 << 19, 1 << 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _in_word() -> np.ndarray:
    """Whether ``\\w`` matches, for every code point."""
    return np.array([c == "_" or c.isalnum() for c in map(chr, range(0x110000))])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words (runs of ``\\w``) of all texts, and each text's number of words."""
    joined = "\n".join(texts).lower()
    lengths = np.array([len(t) for t in texts])
    if len(joined) != lengths.sum() + len(texts) - 1:  # a letter that grows in lower case
        lengths = np.array([len(t.lower()) for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _in_word()[points]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = stop - start
    count = np.diff(np.searchsorted(start, np.append(0, np.cumsum(lengths + 1))))
    if not len(start):
        return np.zeros(0, np.uint64), count
    at = np.flatnonzero(inside)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    power = np.full(int(size.max()), _M1)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return mix(np.add.reduceat(mix(points[at] + _GOLD) * power[place], first) + size.astype(np.uint64)), count


def shingle_sets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, their counts, and each text's number of them.

    A text under five words is one shingle; one without words has none.
    """
    h, words = word_hashes(texts)
    stop = np.cumsum(words)
    left = np.repeat(stop, words) - np.arange(len(h))  # words up to the end of the text
    out = np.full(len(h), _GOLD)
    for k in range(SHINGLE):
        more = np.flatnonzero(left > k)
        out[more] = mix(out[more] + h[more + k] + np.uint64(k))
    whole = (left >= SHINGLE) | (np.repeat(words, words) == left) & (left < SHINGLE)
    out, n = out[whole], np.where(words > 0, np.maximum(1, words - SHINGLE + 1), 0)
    ends = np.cumsum(n)
    for lo, hi in zip((ends - n).tolist(), ends.tolist()):
        out[lo:hi].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[(ends - n)[n > 0]] = True
    at = np.flatnonzero(fresh)
    return out[at], np.diff(at, append=len(out)), np.diff(np.searchsorted(at, np.append(0, ends)))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one text, ascending, and their counts."""
    return shingle_sets_of([text])[:2]


def signatures(ids: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of many weighted sets at once: (docs, m) of the shingles that arrived first.

    ``owner`` ascends. An element's r-th arrival follows the one before by an
    exponential time of rate ``weight``. It leaves when its arrival is later
    than the slowest register of its set (early termination). The fewer are
    left, the more of their arrivals are drawn in one step.
    """
    best = np.full((docs, m), np.inf)
    got = np.zeros((docs, m), np.uint64)
    rate, time = weights.astype(np.float64), np.zeros(len(ids))
    worst = np.full(docs, np.inf)
    drawn = 0
    while len(ids):
        step = max(1, min(64, ARRIVALS // len(ids)))
        a = mix(ids[:, None] + np.arange(drawn + 1, drawn + step + 1, dtype=np.uint64) * _GOLD)
        gap = -np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        gap[:, 0] += time
        arrival = np.add.accumulate(gap, axis=1)
        row, column = np.nonzero(arrival < worst[owner][:, None])
        when, whose = arrival[row, column], owner[row]
        register = (mix(a[row, column] + _GOLD) % np.uint64(m)).astype(np.int64)
        sooner = np.flatnonzero(when < best[whose, register])
        sooner = sooner[np.argsort(-when[sooner], kind="stable")]  # the earliest is written last
        best[whose[sooner], register[sooner]] = when[sooner]
        got[whose[sooner], register[sooner]] = ids[row[sooner]]
        changed = np.unique(whose[sooner])
        worst[changed] = best[changed].max(axis=1)
        time = arrival[:, -1]
        live = np.flatnonzero(time < worst[owner])
        ids, rate, time, owner = ids[live], rate[live], time[live], owner[live]
        drawn += step
    return got


def jp(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard: sum over shared d of 1 / sum_e max(wa_e / wa_d, wb_e / wb_d)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = wa[i].astype(np.float64), wb[j].astype(np.float64)
    ta, tb = float(wa.sum()), float(wb.sum())
    only_a, only_b = ta - x.sum(), tb - y.sum()
    if (x == y).all() or len(i) == 1:
        if len(i) == 1:
            return 1.0 / max(1e-300, only_a / x[0] + only_b / y[0] + 1.0)
        return float((1.0 / ((only_a + only_b + x.sum()) / x)).sum())
    # max(x_e / x_d, y_e / y_d) is x_e / x_d where x_e / y_e >= x_d / y_d.
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    xs, ys, rs = x[order], y[order], ratio[order]
    from_x = np.concatenate([np.cumsum(xs[::-1])[::-1], [0.0]])
    upto_y = np.concatenate([[0.0], np.cumsum(ys)])
    k = np.searchsorted(rs, rs, "left")
    return float((1.0 / ((from_x[k] + only_a) / xs + (upto_y[k] + only_b) / ys)).sum())


def _node(text: Column) -> Column:
    """A 128-bit key of the whole text."""
    return F.unhex(F.md5(text.cast("binary")))


def _portions(texts: pa.Array):
    """(first, texts) of runs of rows with about ``CHARS`` characters, so that long texts do not add up."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1])
        if size >= CHARS:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, node, keys): a key of every whole text and its band keys (eight bytes each; none without words)."""
    workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for first, texts in _portions(batch.column(2)):
                ids, counts, sizes = shingle_sets_of(texts)
                some = np.flatnonzero(sizes)
                sig = signatures(ids, counts, np.repeat(np.arange(len(some)), sizes[some]), len(some))
                keys = np.full((len(some), BANDS), _GOLD)
                for k in range(ROWS):
                    keys = mix(keys * _M1 + sig[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
                out = [b""] * len(texts)
                for i, k in zip(some.tolist(), keys.astype("<u8")):
                    out[i] = k.tobytes()
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(out, pa.binary())], ["doc_id", "node", "keys"])

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node(text).alias("node"), text.alias("text")).mapInArrow(lean(run), "doc_id long, node binary, keys binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ids, counts) of the texts in ``nodes`` (node, doc_id); no counts where all are 1."""

    def run(batches):
        for batch in batches:
            for first, texts in _portions(batch.column(1)):
                ids, counts, sizes = shingle_sets_of(texts)
                ends = np.cumsum(sizes).tolist()
                made = [(ids[e - n : e].astype("<u8").tobytes(), b"" if (counts[e - n : e] == 1).all() else counts[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, sizes.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *(pa.array([x[k] for x in made], pa.binary()) for k in (0, 1))], ["node", "ids", "counts"])

    # A text is read from the row that stands for its copies; rows with both the same are one.
    row = lambda node, i: F.xxhash64(node, F.coalesce(i.cast("string"), F.lit("")))
    text = text_or_empty()
    rows = docs.select(row(_node(text), F.col("doc_id").cast("long")).alias("_row"), text.alias("text"))
    wanted = nodes.select(row(F.col("node"), F.col("doc_id")).alias("_row"), "node")
    own = rows.join(wanted, "_row").where(_node(F.col("text")) == F.col("node"))
    return own.dropDuplicates(["_row", "node"]).select("node", "text").mapInArrow(lean(run), "node binary, ids binary, counts binary")


def _weighted(ids, counts) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<u8")
    return ids, np.frombuffer(counts, "<u4") if len(counts) else np.ones(len(ids), np.uint32)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (a, b) of ``pairs`` whose exact J_P reaches ``similarity``."""
    one = sets.select("node", "ids", "counts")
    joined = pairs.join(one.withColumnsRenamed({"node": "a", "ids": "ids_a", "counts": "counts_a"}), "a").join(one.withColumnsRenamed({"node": "b", "ids": "ids_b", "counts": "counts_b"}), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for row in zip(*batch.columns[2:]):
                a, wa, b, wb = (x.as_buffer() for x in row)
                keep.append(min(len(a), len(b)) > 0 and jp(*_weighted(a, wa), *_weighted(b, wb)) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "ids_a", "counts_a", "ids_b", "counts_b").mapInArrow(lean(run), "a binary, b binary")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a < b) that connect all nodes of a class. nodes: (node, doc_id, keys)."""
    member = nodes.where(F.octet_length("keys") > 0).select("node", F.explode(F.array(*(F.xxhash64(F.lit(b), F.substring(F.col("keys"), 8 * b + 1, 8)) for b in range(BANDS)))).alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    # The centre of a bucket is drawn anew in each band, so that a class has several.
    shared_members = written(member.join(shared, "bucket", "left_semi"), "bucket-members")
    open_ = shared_members.withColumn("rank", F.xxhash64("node", "bucket"))
    wanted = nodes.select("node", "doc_id").join(shared_members.select("node").distinct(), "node", "left_semi")
    sets = written(shingle_sets(docs, wanted), "shingle-sets")
    done: DataFrame | None = None
    for _ in range(STAR_ROUNDS):
        centre = open_.groupBy("bucket").agg(F.min(F.struct("rank", "node")).alias("c")).select("bucket", F.col("c.node").alias("centre"))
        starred = open_.join(centre, "bucket").where("node <> centre").withColumns({"a": F.least("node", "centre"), "b": F.greatest("node", "centre")})
        asked = starred.select("a", "b").distinct()
        if done is not None:
            asked = asked.join(done, ["a", "b"], "left_anti")
        new = written(verified(asked, sets), "star-links")
        done = new if done is None else done.unionAll(new)
        open_ = written(starred.join(done, ["a", "b"], "left_anti").select("bucket", "node", "rank"), "open-members")
        if open_.isEmpty():
            return done
    return done.unionAll(written(rest(shared_members, components(done), nodes, sets), "last-links"))


def rest(member: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the classes found so far, from buckets that hold several.

    A bucket is dealt into blocks of ``BLOCK`` members (fewer where they hold
    many shingles), and every pair of blocks is a task of its own. A task
    compares only members of different classes, each pair in the first bucket
    that it shares, and returns links that join classes, not all links.
    """
    named = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sized = named.join(sets.select("node", F.octet_length("ids").alias("bytes")), "node")
    several = sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1 and n > 2")
    several = several.select("bucket", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = named.join(several, "bucket").withColumn("mine", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    sent = dealt.select("bucket", "node", "root", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("bucket", "node", "root", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    sent = sent.join(nodes.select("node", "keys"), "node").join(sets, "node")
    return sent.groupBy("bucket", "lo", "hi").applyInArrow(_joining_links, "a binary, b binary")


def _joining_links(t: pa.Table) -> pa.Table:
    nodes, roots = t.column("node").to_pylist(), t.column("root").to_pylist()
    mine, lo, hi = t.column("mine").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    keys = np.stack([np.frombuffer(k.as_py(), "<u8") for k in t.column("keys")])
    # The band of this bucket: the first in which all members agree; earlier ones they may share only in part.
    ids, counts = zip(*(_weighted(x.as_py(), c.as_py()) for x, c in zip(t.column("ids"), t.column("counts"))))
    band = int(np.flatnonzero((keys == keys[0]).all(axis=0))[0]) if len(nodes) else 0
    left = np.flatnonzero(mine == lo)
    right = np.flatnonzero(mine == hi)
    words, flat = np.unique(np.concatenate(ids), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    size = np.array([len(x) for x in ids])
    plain = np.array([bool((c == 1).all()) for c in counts])
    # Shared shingles of all pairs, some columns at a time. With shares p and q of the texts' weights,
    # J_P is at most sum min(p, q): so at most the shared part of either text, and sum sqrt(p q).
    both = np.zeros((len(left), len(right)), np.float32)
    weighted = not plain.all()
    bound = (np.zeros_like(both), np.zeros_like(both), np.zeros_like(both)) if weighted else ()
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    share = np.concatenate([c / c.sum(dtype=np.float64) for c in counts])[order].astype(np.float32) if weighted else None
    step = 4096
    for w in range(0, len(words), step):
        a, b = np.searchsorted(flat, (w, w + step))
        dense = np.zeros((len(ids), step), np.float32)
        dense[owner[a:b], flat[a:b] - w] = 1
        both += dense[left] @ dense[right].T
        if weighted:
            part = np.zeros_like(dense)
            part[owner[a:b], flat[a:b] - w] = share[a:b]
            bound[0][:] += part[left] @ dense[right].T
            bound[1][:] += dense[left] @ part[right].T
            np.sqrt(part, out=part)
            bound[2][:] += part[left] @ part[right].T
    union = size[left][:, None] + size[right][None, :] - both
    exact = plain[left][:, None] & plain[right][None, :]
    score = both / np.maximum(union, 1)
    near = both >= SIMILARITY * union - 1e-6
    if weighted:
        most = np.minimum(np.minimum(bound[0], bound[1]), bound[2])
        score = np.where(exact, score, most)
        near = np.where(exact, near, most >= SIMILARITY - 1e-4)  # sums of single precision
    parent = {r: r for r in roots}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out_a, out_b = [], []
    score = np.where(near, score, -1)
    for k in np.argsort(-score, axis=None, kind="stable")[: int(near.sum())].tolist():
        i, j = int(left[k // len(right)]), int(right[k % len(right)])
        if lo == hi and i >= j:
            continue
        x, y = root(roots[i]), root(roots[j])
        if x == y or (band and (keys[i, :band] == keys[j, :band]).any()):
            continue
        if exact[k // len(right), k % len(right)] or jp(ids[i], counts[i], ids[j], counts[j]) >= SIMILARITY:
            parent[x] = y
            out_a.append(min(nodes[i], nodes[j]))
            out_b.append(max(nodes[i], nodes[j]))
    return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by contraction, no driver state.

    Every node moves to its least neighbour, in an order drawn anew each round,
    and on to that one's; edges follow, loops and repeats go, and the next round
    works on what is left, a fraction of the nodes however the edges lie.
    """
    edges = cut(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    named: DataFrame | None = None
    turn = 0
    while True:
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("node"))  # noqa: E731, B023
        near = edges.groupBy("a").agg(F.least(F.min(ranked("b")), F.first(ranked("a")))["node"].alias("up")).select(F.col("a").alias("node"), "up")
        near = cut(near)
        far = near.select(F.col("node").alias("up"), F.col("up").alias("root"))
        moved = cut(near.join(far, "up").select("node", "root"))
        if named is None:
            named = moved
        else:
            later = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            named = cut(named.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        one = edges.join(moved.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").select("x", "b").distinct()
        edges = cut(one.join(moved.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if edges.isEmpty():
            return named
        turn += 1


def _classed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, class_texts, first) for every document.

    first: the node whose rows of id ``class_id`` represent the class.
    """
    sketches = written(sketched(docs), "sketches")
    # Copies share their sketch; the smallest id stands for them.
    nodes = written(sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")), "nodes")
    root = components(links(docs, nodes))
    named = nodes.select("node", F.col("doc_id").alias("rep")).join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "named-texts")
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node"))
    top = named.groupBy("root").agg(least.alias("_t"), F.count(F.lit(1)).alias("class_texts")).select("root", F.col("_t.rep").alias("class_id"), F.col("_t.node").alias("first"), "class_texts")
    of_text = named.join(top, "root").select("node", "class_id", "first", "class_texts")
    return sketches.select("doc_id", "node").join(of_text, "node")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, is_representative, class_texts) for every document.

    class_id: the smallest doc_id of the class. Null text counts as empty;
    texts without words are linked only to their equals. A class none of whose
    documents has an id has no class_id either. Rows of one doc_id with
    different texts are judged each by its own text, so that two classes may
    then have the same class_id. Repeated rows give repeated rows, all of them
    representative if one is; an empty table gives none. Of equally small ids
    the smaller text key represents. Other columns are ignored.
    """
    one = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first"))
    return _classed(docs).select("doc_id", "class_id", one.alias("is_representative"), "class_texts")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the representative, once.

    Documents without an id all stay. Different texts under one doc_id stay
    unless each is a near copy of another. All columns are kept as they are.
    """
    known = docs.where("doc_id is not null")
    kept = _classed(known).where("doc_id = class_id and node = first").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct()
    # The row travels as one column, so that its names clash with none in here.
    rows = known.select(F.struct(*docs.columns).alias("_r"), F.col("doc_id").cast("long").alias("_id"), _node(text_or_empty()).alias("_node"))
    first = rows.join(kept, ["_id", "_node"], "left_semi").dropDuplicates(["_id", "_node"])
    return first.select(*(F.col("_r")[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))
