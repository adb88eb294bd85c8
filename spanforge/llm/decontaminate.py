"""Benchmark decontamination by spaced seeds. DataFrame functions only.

A seed is a fixed mask over consecutive tokens that reads some positions and
ignores the others, so a hit survives substitutions at ignored positions. The
masks' hashes of all training windows are joined with those of the benchmark.
Around each hit, the two token sequences are compared along the hit's diagonal:
the best-scoring stretch (+1 a match, -``MISMATCH`` a substitution) must score
``MIN_SCORE``, or ``SHARE`` of the item's words where that is less, for the
document to count as contaminated by the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import cut, text_or_empty, written
from spanforge.llm.quality import let

#: A mask reads positions {0, 1} + {0, a} + {0, b}: eight tokens. The three share
#: their first step, so all windows of all masks cost seven hashes a token.
#: 11111111, 11011011011 and 1100110110011.
MASKS = ((2, 4), (3, 6), (4, 7))
MISMATCH, MIN_SCORE = 2, 12
#: Numerator and denominator: 15 words with two substitutions apart score 9, three fifths.
SHARE = (3, 5)
#: Benchmark seeds that may be broadcast (some hundred bytes each); beyond it the join shuffles.
BROADCAST_SEEDS = 200_000
#: Hits that may be broadcast to the documents' texts; beyond it these are shuffled.
BROADCAST_HITS = 200_000
#: Words of 64 bits in the sieve that large benchmarks' seeds make: its size is bounded, whatever theirs is.
SIEVE_WORDS = 1 << 20
BREAK = r"[^\p{L}\p{N}]+"


def span(mask: tuple[int, int]) -> int:
    return 2 + sum(mask)


def needed(n: Column) -> Column:
    """The score that counts for an item of ``n`` words."""
    return F.least(F.lit(MIN_SCORE), F.ceil(n * SHARE[0] / SHARE[1]).cast("int"))


def with_seeds(df: DataFrame, tokens: str = "_tokens") -> DataFrame:
    """Adds ``_seeds``: the hashes of all windows, mask after mask."""

    def joined(df: DataFrame, name: str, source: str, by: int) -> DataFrame:
        # A column of its own, read twice, is computed once.
        later = F.slice(F.col(source), by + 1, F.size(source))
        return df.withColumn(name, F.zip_with(F.col(source), later, lambda a, b: F.xxhash64(a, b)))

    df = joined(df, "_p", tokens, 1)
    whole = []
    for i, (a, b) in enumerate(MASKS):
        df = joined(joined(df, f"_q{i}", "_p", a), f"_r{i}", f"_q{i}", b)
        whole.append(F.slice(F.col(f"_r{i}"), 1, windows(F.size(tokens), i)))
    return df.withColumn("_seeds", F.concat(*whole)).drop("_p", *(f"_{x}{i}" for x in "qr" for i in range(len(MASKS))))


def windows(n: Column, mask: int) -> Column:
    return F.greatest(n - (span(MASKS[mask]) - 1), F.lit(0))


def position(at: Column, mask: Column, n: Column) -> Column:
    """Where in the text a window starts, from its place in ``_seeds``."""
    before, out = F.lit(0), F.lit(None).cast("int")
    for i in range(len(MASKS)):
        out = F.when(mask == i, at - before).otherwise(out)
        before = before + windows(n, i)
    return out


def mask_of(at: Column, n: Column) -> Column:
    before, out = F.lit(0), F.lit(len(MASKS) - 1)
    ends = []
    for i in range(len(MASKS)):
        before = before + windows(n, i)
        ends.append(before)
    for i in range(len(MASKS) - 2, -1, -1):
        out = F.when(at < ends[i], i).otherwise(out)
    return out


def tokenised(df: DataFrame, keep: list[str]) -> DataFrame:
    """Hashes of the lower-case words (letters and digits) of whole texts; null text: none."""
    words = F.filter(F.split(F.lower(text_or_empty()), BREAK), lambda w: w != "")
    return df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_tokens"))


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """(seed, mask, item_pos, item_id, item_tokens). Items under eight words have no seed and are no evidence."""
    items = with_seeds(tokenised(benchmark, ["item_id"]))
    rows = items.select("item_id", F.col("_tokens").alias("item_tokens"), F.posexplode_outer("_seeds").alias("_at", "seed")).where("seed is not null")
    n = F.size("item_tokens")
    rows = rows.withColumn("mask", mask_of(F.col("_at"), n))
    return rows.select("seed", "mask", position(F.col("_at"), F.col("mask"), n).alias("item_pos"), "item_id", "item_tokens").distinct()


def seed_hits(docs: DataFrame, seeds: DataFrame, few: bool) -> DataFrame:
    """(doc_id, item_id, diagonal, item_words), each once. The exploded rows hold no text."""
    tokens = with_seeds(tokenised(docs, ["doc_id"]))
    # An outer explode: an inner one would repeat all the hashing in a filter below it.
    rows = tokens.select("doc_id", F.size("_tokens").alias("_n"), F.posexplode_outer("_seeds").alias("_at", "seed"))
    narrow = seeds.select("seed", "mask", "item_pos", "item_id", F.size("item_tokens").alias("item_words"))
    found = rows.join(F.broadcast(narrow), "seed") if few else sieved(rows, narrow).join(narrow, "seed")
    # A hash of one mask equals one of another only by chance; the check of the overlap would not care.
    diagonal = (position(F.col("_at"), F.col("mask"), F.col("_n")) - F.col("item_pos")).cast("int")
    return found.select("doc_id", "item_id", diagonal.alias("diagonal"), "item_words").where("diagonal is not null").distinct()


def sieved(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows whose seed may be one of ``seeds``: others stay where they are instead of being shuffled."""
    word = F.pmod(F.shiftright("seed", 6), F.lit(SIEVE_WORDS)).alias("_word")
    bit = F.pmod("seed", F.lit(64)).cast("int")
    sieve = seeds.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    some = rows.where("seed is not null").withColumn("_word", word).join(F.broadcast(sieve), "_word")
    return some.where(F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(1) == 1).drop("_word", "_bits")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified hits: doc_id, item_id, score, matched, start (word), item_start."""
    seeds = cut(benchmark_seeds(benchmark))
    few = seeds.count() <= BROADCAST_SEEDS
    found = written(seed_hits(docs, seeds, few), "seed-hits")
    diagonals = found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "item_words")).alias("_hits"))
    if found.count() <= BROADCAST_HITS:  # then only the texts that are hit are read again, where they are
        diagonals = F.broadcast(diagonals)
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(diagonals, F.col("_id").eqNullSafe(F.col("doc_id")))
    around = let(
        F.transform(F.filter(F.split(F.lower(text_or_empty()), BREAK), lambda w: w != ""), lambda w: F.xxhash64(w)),
        lambda t: F.transform(
            "_hits",
            lambda h: F.struct(h["item_id"].alias("item_id"), h["diagonal"].alias("diagonal"), F.slice(t, F.greatest(h["diagonal"], F.lit(0)) + 1, h["item_words"]).alias("tokens")),
        ),
    )
    near = texts.select("doc_id", F.explode(around).alias("h")).select("doc_id", "h.*")
    items = seeds.select("item_id", "item_tokens").distinct()
    near = near.join(F.broadcast(items) if few else items, "item_id")
    first, item_first = F.greatest(F.col("diagonal"), F.lit(0)), F.greatest(-F.col("diagonal"), F.lit(0))
    same = F.zip_with("tokens", F.slice("item_tokens", item_first + 1, F.size("item_tokens")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    zero = F.struct(*(F.lit(0).alias(x) for x in ("at", "run", "begin", "n", "score", "start", "matched")))

    def step(a: Column, equal: Column) -> Column:
        run = F.greatest(a["run"], F.lit(0)) + F.when(equal, 1).otherwise(-MISMATCH)
        begin = F.when(a["run"] <= 0, a["at"]).otherwise(a["begin"])
        n = F.when(a["run"] <= 0, 0).otherwise(a["n"]) + F.when(equal, 1).otherwise(0)
        best = run > a["score"]
        return F.struct(
            (a["at"] + 1).alias("at"),
            run.alias("run"),
            begin.alias("begin"),
            n.alias("n"),
            F.when(best, run).otherwise(a["score"]).alias("score"),
            F.when(best, begin).otherwise(a["start"]).alias("start"),
            F.when(best, n).otherwise(a["matched"]).alias("matched"),
        )

    scored = near.select("doc_id", "item_id", first.alias("_first"), item_first.alias("_item_first"), needed(F.size("item_tokens")).alias("_needed"), F.aggregate(same, zero, step).alias("_s"))
    return scored.where(F.col("_s.score") >= F.col("_needed")).select(
        "doc_id",
        "item_id",
        F.col("_s.score").cast("long").alias("score"),
        F.col("_s.matched").cast("long").alias("matched"),
        (F.col("_first") + F.col("_s.start")).cast("long").alias("start"),
        (F.col("_item_first") + F.col("_s.start")).cast("long").alias("item_start"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and benchmark item, with its best overlap.

    Null or short texts (under eight words) have no hit. Among equal scores the
    overlap that starts first counts. Repeated rows of a document give one row;
    with an empty table there is none.
    """
    best = F.max_by(F.struct("matched", "start", "item_start"), F.struct(F.col("score"), -F.col("start"), -F.col("item_start")))
    return hits(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best.alias("_b")).select("doc_id", "item_id", "score", "_b.matched", "_b.start", "_b.item_start")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; those without an id go if any of them is hit.

    Null, empty and short texts stay, and so do all rows where a table is
    empty. Repeated rows stay or go together. All columns are kept as they are.
    """
    bad = written(hits(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated-ids")
    if bad.count() <= BROADCAST_HITS:
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
