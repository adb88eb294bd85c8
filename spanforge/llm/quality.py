"""Quality rules with risk-controlled cutoffs. DataFrame functions only.

Each rule is a share (per mille) of a text; a document is rejected where a
share exceeds its stratum's cutoff. Cutoffs come from labelled documents: going
from the loosest to the tightest of a fixed grid, a cutoff is certified while
the exact binomial test rejects "more than ``ALPHA`` / rules of the good
documents are lost", at level ``DELTA`` / (strata * rules). The sequence within
a rule needs no further correction; the rules share ALPHA by the union bound.
With probability 1 - DELTA no stratum loses more than ALPHA of its good ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import text_or_empty, written

ALPHA, DELTA = 0.05, 0.05
GRID = (0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800)
RULES = ("symbols", "dup_lines", "repeats", "capitals")
#: Strata whose cutoffs may be broadcast; beyond it they are joined by shuffle.
BROADCAST_STRATA = 10_000
WINDOW = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _pairs(h: Column, step: int) -> Column:
    """h[i] joined with h[i + step]; the last ``step`` entries are void."""
    return F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more."""
    marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        before = F.concat(F.array(F.lit(False)), same)
        both = F.zip_with(same, F.slice(before, 1, F.size(same)), lambda a, b: a | b)
        return F.sort_array(F.transform(F.filter(F.zip_with(s, both, lambda x, m: F.struct(x["i"].alias("i"), m.alias("m"))), lambda x: x["m"]), lambda x: x["i"]))

    return let(
        marked,
        lambda s: F.aggregate(
            positions(s),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        )["n"],
    )


def repeat_words(words: Column) -> Column:
    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_covered(windows))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    eights = let(hashed, lambda h: F.slice(_pairs(_pairs(_pairs(h, 1), 2), 4), 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(eights, count))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and counts of every whole text. Null text: no words, one empty line."""
    text = F.col("_text")
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return (
        docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text_or_empty().alias("_text"))
        .select(
            "doc_id",
            "stratum",
            counts.alias("_w"),
            line_counts.alias("_l"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit(r"[A-Z]{3,}")).cast("long").alias("n_capitals"),
        )
        .select("doc_id", "stratum", "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_capitals")
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def shares() -> dict[str, Column]:
    """Per mille, whole numbers, so that every engine rounds alike."""
    of = lambda part, whole: F.expr(f"{part} * 1000 div greatest({whole}, 1)")
    return {"symbols": of("n_symbols", "word_chars"), "dup_lines": of("n_dup_lines", "n_lines"), "repeats": of("n_repeat_words", "n_words"), "capitals": of("n_capitals", "n_words")}


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), exact, term by term in logarithms."""
    ratio = math.log(p) - math.log1p(-p)

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + F.lit(ratio)
        top = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(a["total"], term) - top))).alias("total"))

    first = n * F.lit(math.log1p(-p))
    return F.when(k >= n * F.lit(p), F.lit(0.0)).otherwise(
        F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)")), F.struct(first.alias("term"), first.alias("total")), step)["total"]
    )


def certified_cutoffs(measures: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) for rules that some cutoff is certified for.

    Good: quality 1 and not toxic; of repeated labels the worst counts; null
    labels are left out. Documents that fail the base rules are no evidence.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")
    s = shares()
    held = measures.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    grid = F.array(*(F.lit(c) for c in GRID))
    lost = [F.sum(F.when(s[r] > c, 1).otherwise(0)).alias(f"{r}_{c}") for r in RULES for c in GRID]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *lost)
    strata = measures.select("stratum").distinct().agg(F.count(F.lit(1)).alias("n_strata"))
    tests = counts.select(
        "stratum", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.array(*(F.col(f"{r}_{c}") for c in GRID)).alias("lost")) for r in RULES))).alias("t")
    ).select("stratum", "n", "t.rule", F.explode(F.arrays_zip(grid.alias("cutoff"), F.col("t.lost").alias("lost"))).alias("x"))
    tests = tests.select("stratum", "rule", "n", F.col("x.cutoff").alias("cutoff"), F.col("x.lost").alias("lost"))
    level = math.log(delta / len(RULES)) - F.log(F.greatest(F.lit(int(strata.first()[0])), F.lit(1)))
    passed = tests.withColumn("ok", log_binomial_cdf(F.col("lost"), F.col("n"), alpha / len(RULES)) <= level)
    # Fixed sequence: a cutoff counts only if all looser ones are certified.
    stop = F.max(F.when(~F.col("ok"), F.col("cutoff")))
    return passed.groupBy("stratum", "rule").agg(stop.alias("stop"), F.collect_set("cutoff").alias("all")).select(
        "stratum", "rule", F.array_min(F.filter("all", lambda c: F.col("stop").isNull() | (c > F.col("stop")))).alias("cutoff")
    ).where("cutoff is not null")


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts and verdicts for every document.

    Strata with too few labels certify nothing, and there only the base rules
    reject. A null language is the stratum ''. Ties with a cutoff are kept;
    repeated rows are judged one by one; an empty table gives no rows.
    """
    measures = written(measured(docs), "quality-measures")
    cutoffs = certified_cutoffs(measures, labels, alpha, delta)
    wide = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))
    if wide.count() <= BROADCAST_STRATA:
        wide = F.broadcast(wide)
    s = shares()
    over = [F.when(s[r] > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]
    rejected = F.concat_ws(",", *over)
    return measures.join(wide, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (rejected == "")).alias("kept"), rejected.alias("rejected_by")
    )


def oracle() -> str:
    rule = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "capitals": ("n_capitals", "n_words")}
    share = lambda r: f"({rule[r][0]} * 1000 // greatest({rule[r][1]}, 1))"
    return rf"""
with d as (select row_number() over () as k, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
w as (select k, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d)),
win as (select k, i, w, lead(w, 7) over o is not null as whole, [w, lead(w, 1) over o, lead(w, 2) over o, lead(w, 3) over o, lead(w, 4) over o, lead(w, 5) over o, lead(w, 6) over o, lead(w, 7) over o] as s
        from w window o as (partition by k order by i)),
rep as (select k, i, w, case when whole and count(*) over (partition by k, s, whole) > 1 then 1 else 0 end as r from win),
cov as (select k, length(w) as c, max(r) over (partition by k order by i rows between 7 preceding and current row) as r from rep),
wc as (select k, count(*) as n_words, sum(c)::bigint as word_chars, sum(r)::bigint as n_repeat_words from cov group by k),
ln as (select k, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
       from (select k, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by k),
m as (select doc_id, stratum, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, len(regexp_extract_all(text, '[A-Z]{{3,}}')) as n_capitals
      from d left join wc using (k) left join ln using (k)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
good as (select doc_id from labels where doc_id is not null and quality is not null group by doc_id having min(quality) = 1 and max(coalesce(toxic, 0)) = 0),
v as (select stratum, unnest([{", ".join(f"{{'rule': '{r}', 'share': {share(r)}}}" for r in RULES)}], recursive := true) from j where not base_failed and doc_id in (select doc_id from good)),
g as (select unnest([{", ".join(map(str, GRID))}]) as cutoff),
t as (select stratum, rule, cutoff, count(*) as n, count(*) filter (where share > cutoff) as lost from v, g group by all),
p as (select *, case when lost >= n * {ALPHA / len(RULES)} then 1.0 else
        list_sum(list_transform(range(0, lost + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({ALPHA / len(RULES)}) + (n - x) * ln(1 - {ALPHA / len(RULES)})))) end as prob from t),
ok as (select *, prob <= {DELTA} / {len(RULES)} / (select count(distinct stratum) from j) as ok from p),
st as (select stratum, rule, max(cutoff) filter (where not ok) as stop from ok group by all),
c as (select stratum, rule, min(cutoff) as cutoff from ok join st using (stratum, rule) where stop is null or cutoff > stop group by all),
x as (select stratum, {", ".join(f"max(cutoff) filter (where rule = '{r}') as cut_{r}" for r in RULES)} from c group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {" and ".join(f"coalesce({share(r)} <= cut_{r}, true)" for r in RULES)} as kept,
       concat_ws(',', {", ".join(f"case when {share(r)} > cut_{r} then '{r}' end" for r in RULES)}) as rejected_by
from j left join x using (stratum)
"""
