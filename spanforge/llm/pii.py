"""Personal data by weak supervision. DataFrame functions only.

Strict patterns (the base kinds) and loose ones propose spans; strict matches
that fail their check are candidates too. Labelers vote for or against each
span: structure and check digits, words of the context before it, gazetteers
(providers, country codes, key prefixes; against: reserved and sample values),
shape, surroundings, and variety of characters. Votes are counted per pattern
over the whole corpus; expectation-maximisation (Dawid and Skene, two classes,
conditionally independent voters) estimates each labeler's reliability from
those counts alone. Its posteriors train the final classifier, a logistic
regression on features of the span itself and its kind, not on votes; it
decides every further span. Base spans always stay.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import text_or_empty, written
from spanforge.llm.quality import let

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Leftmost, non-overlapping, as the plain patterns find them; a run is entered only
#: at its start (or where the last match ended), so long runs cost linear time.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further spans: written-out addresses, numbers in groups, account and social security numbers, keys and secrets.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{1,63}){1,4}",
    "phone": r"(?<![0-9A-Za-z+.,/-])(?:\([0-9]{2,5}\)\x20?)?[0-9]{2,5}(?:[-./\x20][0-9]{2,5}){1,4}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,63}[0-9])(?=[0-9_-]{0,63}[A-Za-z])[A-Za-z0-9_-]{16,128}(?![A-Za-z0-9_-])",
}
LOOSE_GATE = {"email": "(?i)[(\\[]at[)\\]]", "phone": r"[0-9]{2}[-./)\x20]+[0-9]{2}", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]{4}", "key": r"[A-Za-z0-9_-]{16}"}
ALL_KINDS = (*KINDS, *(k for k in LOOSE if k not in KINDS))

# Words and codes that labelers look up.
CONTEXT = ("account", "addr", "address", "bank", "call", "card", "cell", "contact", "correo", "e-mail", "email", "fax", "handy", "host", "iban", "key", "konto", "mail", "mobile", "password", "phone", "reach", "secret", "server", "social", "ssn", "tel", "telefon", "token", "visa", "write")
AGAINST = ("article", "build", "chapter", "commit", "doi", "figure", "hash", "isbn", "issn", "item", "md5", "no", "nr", "order", "page", "patent", "release", "revision", "section", "serial", "sha1", "sku", "ticket", "v", "version")
PROVIDERS = ("aol", "gmail", "gmx", "hotmail", "icloud", "live", "mail", "outlook", "proton", "protonmail", "web", "yahoo", "yandex")
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "hf_", "sk_live_", "sk-", "xoxb-", "xoxp-")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
SAMPLES = ("000-00-0000", "0.0.0.0", "078-05-1120", "1.2.3.4", "123-45-6789", "123-456-7890", "127.0.0.1", "219-09-9999", "255.255.255.255")

BEFORE, AFTER = 24, 4
SPAN = "struct<kind: string, start: bigint, stop: bigint, found: string, before: string, after: string>"
#: Matches whose places are added up in one go; blocks keep a text of very many matches from copying a growing array for each.
MATCH_BLOCK = 256


def luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: let(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, found: Column) -> Column:
    """What a strict match must fulfil; failing matches are dropped."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(
            F.split(found, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: F.when(F.char_length(x) <= 3, x.cast("int") <= 255).otherwise(False))
        )
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(False)
    return n.between(9, 15)


def running(lengths: Column) -> Column:
    """Sums of the first 1, 2, ... entries, block by block."""
    none = F.expr("cast(array() as array<bigint>)")
    add = lambda a, x: let(a["at"] + x, lambda to: F.struct(to.alias("at"), F.concat(a["out"], F.array(to)).alias("out")))
    sums = lambda xs, at: F.aggregate(xs, F.struct(at.alias("at"), none.alias("out")), add)["out"]
    count = F.ceil(F.size(lengths) / MATCH_BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(lengths, k * MATCH_BLOCK + 1, MATCH_BLOCK))
    zero = F.lit(0).cast("bigint")

    def joined(bs: Column) -> Column:
        ends = sums(F.transform(bs, lambda x: F.aggregate(x, zero, lambda a, y: a + y)), zero)
        return F.flatten(F.zip_with(bs, F.concat(F.array(zero), F.slice(ends, 1, F.size(bs) - 1)), lambda x, at: sums(x, at)))

    return let(blocks, joined)


def matches(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    """All matches with their code-point spans: the pieces between matches give the offsets."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def spans(found: Column, between: Column) -> Column:
        ends = running(F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: (F.char_length(m) + F.char_length(b)).cast("bigint")))
        sides = F.zip_with(F.slice(between, 1, F.size(found)), F.slice(between, 2, F.size(found)), lambda b, a: F.struct(F.right(b, F.lit(BEFORE)).alias("before"), F.left(a, F.lit(AFTER)).alias("after")))
        placed = F.zip_with(found, ends, lambda m, e: F.struct(m.alias("m"), e.alias("e")))
        one = lambda x, s: F.struct(F.lit(kind).alias("kind"), (x["e"] - F.char_length(x["m"])).alias("start"), x["e"].alias("stop"), x["m"].alias("found"), s["before"].alias("before"), s["after"].alias("after"))
        return F.zip_with(placed, sides, one)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    whole = let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda b: spans(m, b))))
    return F.when(gate, whole).otherwise(none)


def strict_gate(text: Column, kind: str) -> Column:
    sure = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": text.rlike(r"(?:[0-9][\x20-]?){13}"), "phone": text.contains("+")}
    return sure[kind]


def proposed(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, ``base`` (checked strict spans by kind) and ``loose`` (other candidates, clear of the base)."""
    text = F.col("_text")
    strict = {k: F.col(f"_{k}") for k in KINDS}
    base = F.concat(*(F.filter(c, _checked(k)) for k, c in strict.items()))
    # Shorter digit runs are met wherever one long enough makes the text be searched; they are plain numbers.
    long = {"card": lambda s: F.char_length(_digits(s["found"])) >= 12}
    failed = [F.filter(F.filter(c, long.get(k, lambda s: F.lit(True))), _checked(k, False)) for k, c in strict.items() if k != "email"]
    loose = F.concat(*failed, *(F.col(f"_loose_{k}") for k in LOOSE))
    out = docs.select(*carry, text_or_empty().alias("_text"))
    out = out.select(*carry, *(matches(text, k, STRICT[k], strict_gate(text, k)).alias(f"_{k}") for k in KINDS), *(matches(text, k, p, text.rlike(LOOSE_GATE[k])).alias(f"_loose_{k}") for k, p in LOOSE.items()))
    out = out.select(*carry, base.alias("base"), loose.alias("loose"))
    # Only what overlaps no base span: its number is read off the sorted ends, not from every pair.
    clear = let(
        F.struct(F.array_sort(F.transform("base", lambda b: b["start"])).alias("a"), F.array_sort(F.transform("base", lambda b: b["stop"])).alias("b")),
        lambda e: F.filter("loose", lambda s: below(e["a"], s["stop"]) == below(e["b"], s["start"] + 1)),
    )
    return out.withColumn("loose", F.when((F.size("loose") == 0) | (F.size("base") == 0), F.col("loose")).otherwise(clear))


def _checked(kind: str, want: bool = True):
    return lambda s: holds(kind, s["found"]) if want else ~holds(kind, s["found"])


def below(sorted_: Column, x: Column) -> Column:
    """How many of the ascending values are less than ``x``, by bisection (arrays up to 2**24)."""
    n = F.size(sorted_)
    halves = F.array(*(F.lit(1 << k) for k in range(24, -1, -1)))
    step = lambda at, h: F.when(at + h <= n, F.when(F.get(sorted_, at + h - 1) < x, at + h).otherwise(at)).otherwise(at)
    return F.aggregate(halves, F.lit(0), step)


def mod97(found: Column) -> Column:
    """Remainder of an account number's check: first four signs last, letters as 10 to 35."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _words(values, tail: str = r"[^A-Za-z0-9]*$") -> str:
    return r"(?i)(?<![A-Za-z])(?:" + "|".join(values) + ")" + tail


def _same(digits: Column) -> Column:
    return digits.rlike(r"([0-9])\1{6,}") | digits.rlike("^(?:0123|1234|9876)")


def _structure(span: Column) -> Column:
    """True, false, or null where the kind has nothing to check."""
    found, digits = span["found"], _digits(span["found"])
    plain = F.replace(found, F.lit(" "), F.lit(""))
    length = F.element_at(F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair)), F.substr(plain, F.lit(1), F.lit(2)))
    n = F.char_length(digits)
    of = {
        "email": F.when(found.rlike(r"(?i)(?:@|at[)\]]).*[.)\]]\x20?[a-z]{2,}$"), True),
        "ip": holds("ip", found),
        "card": holds("card", found),
        "phone": F.when(~n.between(7, 15), False).when(found.rlike(r"^\+|^\(|^[0-9]{3}[-.\x20][0-9]{3}[-.\x20][0-9]{4}$"), True),
        "iban": (F.coalesce(length, F.lit(0)) == F.char_length(plain)) & (mod97(found) == 1),
        "ssn": ~found.rlike("^(?:000|666|9)|-00-|-0000$"),
        "key": F.when(found.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$") | found.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")"), True),
    }
    return reduce(lambda out, k: F.when(span["kind"] == k, of[k]).otherwise(out), of, F.lit(None).cast("boolean"))


def _dated(found: Column) -> Column:
    """Looks like a date, a span of years, a price or a version."""
    return found.rlike(r"^(?:(?:19|20)[0-9]{2}[-./\x20](?:[01]?[0-9]|(?:19|20)[0-9]{2})(?:[-./\x20][0-3]?[0-9])?|[0-3]?[0-9][-./][0-3]?[0-9][-./](?:19|20)?[0-9]{2})$")


def _glued(span: Column) -> Column:
    return span["before"].rlike(r"[A-Za-z0-9_=/#$-]$|[0-9][.,]$") & ~span["before"].rlike(r"(?i)(?:password|secret|token|key)[=:]$") | span["after"].rlike(r"^(?:[A-Za-z0-9_/-]|[.,][0-9])")


def _known(span: Column) -> Column:
    found = span["found"]
    return found.rlike(r"(?i)[@)\]]\x20?(?:" + "|".join(PROVIDERS) + r")[0-9]{0,3}\x20?[.(\[]") | found.rlike("^(?:" + "|".join([*KEY_PREFIXES, *IBAN_LENGTHS]) + ")") | found.rlike(r"^\+(?:1|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])")


def _reserved(span: Column) -> Column:
    return span["found"].isin(*SAMPLES) | span["found"].rlike(r"(?i)^(?:foo|test|user|name|someone)\x20?(?:@|.at.)|^(?:10|127|192\.168)\.|555-01[0-9]{2}$")


def _variety(found: Column) -> Column:
    return F.size(F.array_distinct(F.split(F.regexp_replace(found, "[^A-Za-z0-9]", ""), "")))


def votes(span: Column) -> list[Column]:
    """1: personal, -1: not, 0: no opinion."""
    vote = lambda yes, no: F.when(F.coalesce(no, F.lit(False)), -1).when(F.coalesce(yes, F.lit(False)), 1).otherwise(0)
    found, digits, kinds = span["found"], _digits(span["found"]), _variety(span["found"])
    right = _structure(span)
    numeric = span["kind"].isin("phone", "card", "ssn")
    return [
        vote(right, ~right),
        vote(span["before"].rlike(_words(CONTEXT)), span["before"].rlike(_words(AGAINST))),
        vote(_known(span), _reserved(span)),
        vote(numeric & found.rlike(r"[()+-]"), _same(digits) | _dated(found)),
        vote(F.lit(False), _glued(span)),
        vote((span["kind"] == "key") & (kinds >= 12), kinds <= F.when(numeric, 2).otherwise(4)),
    ]


N_LABELERS = 6
#: Of a vote for, none, and against, in a span that is personal; mirrored for others. Structure is the surest.
EXPECTED = ((0.75, 0.22, 0.03), *((0.4, 0.5, 0.1),) * (N_LABELERS - 1))


def vote_counts(spans: DataFrame) -> dict[tuple[int, ...], int]:
    """How often each pattern of votes occurs in the corpus; at most 3**N_LABELERS rows."""
    rows = _each(spans).groupBy("v").count().collect()
    return {tuple(map(int, r.v.split(","))): r["count"] for r in rows}


def _pattern(s: Column) -> Column:
    return F.concat_ws(",", *(v.cast("string") for v in votes(s)))


def _each(spans: DataFrame) -> DataFrame:
    """(v, kind, f) of every span, base and loose: vote pattern, kind and features."""
    one = F.explode(F.transform(F.concat("base", "loose"), lambda s: F.struct(_pattern(s).alias("v"), s["kind"].alias("kind"), _bits(s).alias("f"))))
    return spans.select(one.alias("x")).select("x.*")


def _start(j: int, c: int, v: int) -> float:
    return EXPECTED[j][1 - v if c else 1 + v]


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 60):
    """EM over the counted patterns: class prior and each labeler's vote rates, with a prior of being right worth a twentieth of all spans."""
    classes, values = (0, 1), (-1, 0, 1)
    rate = {(j, c, v): _start(j, c, v) for j, c, v in product(range(N_LABELERS), classes, values)}
    prior, post = 0.5, {}
    total = sum(counts.values())
    weight = max(2.0, total / 20)
    for _ in range(rounds):
        for p in counts:
            like = [(prior if c else 1 - prior) * math.prod(rate[j, c, v] for j, v in enumerate(p)) for c in classes]
            post[p] = like[1] / max(sum(like), 1e-300)
        prior = (sum(n * post[p] for p, n in counts.items()) + weight / 2) / (total + weight)
        for j, c in product(range(N_LABELERS), classes):
            share = {v: weight * _start(j, c, v) for v in values}
            for p, n in counts.items():
                share[p[j]] += n * (post[p] if c else 1 - post[p])
            whole = sum(share.values())
            for v in values:
                rate[j, c, v] = share[v] / whole
    return prior, rate, post


FEATURES = 14


def features(span: Column) -> list[Column]:
    """Properties of the span itself and its neighbourhood, true or false."""
    found, digits = span["found"], _digits(span["found"])
    right = _structure(span)
    return [
        F.coalesce(right, F.lit(False)),
        F.coalesce(~right, F.lit(False)),
        span["before"].rlike(_words(CONTEXT)),
        span["before"].rlike(_words(AGAINST)),
        _known(span),
        _reserved(span),
        _same(digits) | _dated(found),
        _glued(span),
        F.char_length(digits) >= 9,
        F.char_length(found) >= 20,
        found.rlike("[A-Za-z]"),
        found.rlike(r"[()+-]"),
        _variety(found) >= 6,
        _variety(found) >= 12,
    ]


def _bits(span: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.when(f, 1 << j).otherwise(0) for j, f in enumerate(features(span))))


def _row(kind: str, bits: int) -> np.ndarray:
    return np.array([1.0, *(float(kind == k) for k in ALL_KINDS), *(float(bits >> j & 1) for j in range(FEATURES))])


def span_classifier(rows: list[tuple[str, int, int, float]], steps: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on kind and features, fitted to the posteriors by Newton's method.

    rows: (kind, features, spans, sum of their posteriors). Returns bias,
    weights of ``ALL_KINDS`` and of the features; zeros without any row, which
    accept nothing.
    """
    w = np.zeros(1 + len(ALL_KINDS) + FEATURES)
    if not rows:
        return w
    x = np.stack([_row(k, b) for k, b, _, _ in rows])
    n, y = (np.array([r[i] for r in rows], float) for i in (2, 3))
    total = n.sum()
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * p - y) / total + ridge * w
        h = (x * (n * p * (1 - p) / total)[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w = w - move
        if np.abs(move).max() < 1e-9:
            break
    return w


def trained(spans: DataFrame) -> np.ndarray:
    """Votes to posteriors to classifier. What the driver gets: a row per vote pattern, then one per kind and features."""
    _, _, post = reliabilities(vote_counts(spans))
    if not post:
        return span_classifier([])
    table = spans.sparkSession.createDataFrame([(",".join(map(str, p)), float(x)) for p, x in post.items()], "v string, post double")
    # Posteriors in whole millionths, so that sums do not depend on their order.
    sums = _each(spans).join(F.broadcast(table), "v").groupBy("kind", "f").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("post") * 1_000_000).cast("long")).alias("p"))
    return span_classifier([(r.kind, r.f, r.n, r.p / 1e6) for r in sums.orderBy("kind", "f").collect()])


def detected(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, ``base`` and ``added``: arrays of spans for every document.

    Null and empty texts have no spans; texts are read whole, however long.
    Repeated rows are handled one by one (each counts in training); an empty
    table trains on nothing and adds nothing. A score of zero adds nothing.
    """
    spans = written(proposed(docs, carry), "pii-spans")
    w = trained(spans)

    def accepted(s: Column) -> Column:
        z = reduce(lambda out, k: F.when(s["kind"] == k, float(w[0] + w[1 + ALL_KINDS.index(k)])).otherwise(out), ALL_KINDS, F.lit(float(w[0])))
        return reduce(lambda a, b: a + b, (F.when(f, float(w[1 + len(ALL_KINDS) + j])).otherwise(0.0) for j, f in enumerate(features(s))), z) > 1e-9

    return spans.select(*carry, "base", F.filter("loose", accepted).alias("added"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def _in_order(spans: Column, kinds) -> Column:
    of_kind = lambda k: F.sort_array(F.filter(spans, lambda s: s["kind"] == k))
    return F.concat(*map(of_kind, kinds))


def digests(docs: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans, one row per row of ``docs``.

    Null and empty texts give no spans, repeated rows equal rows, an empty table
    none. Columns beyond doc_id and text are ignored, whatever their names.
    """
    found = detected(docs)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed(_in_order(F.concat("base", "added"), ALL_KINDS)).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[KIND]``; other columns stay.

    Overlapping spans are replaced as one, under the first one's kind.
    """
    # The row travels as one column, so that its names clash with none in here.
    found = detected(docs.select(F.struct(*docs.columns).alias("row"), "text"), ("row",))
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["stop"], s["kind"])))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    text = F.col("row.text")

    def step(a: Column, s: Column) -> Column:
        piece = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["stop"].alias("at"), F.concat(a["out"], piece, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        )

    whole = let(F.aggregate(spans, start, step), lambda r: F.concat(r["out"], F.substr(text, (r["at"] + 1).cast("int"))))
    out = F.when(F.size("base") + F.size("added") == 0, text).otherwise(whole).alias("text")
    return found.select(*(out if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
