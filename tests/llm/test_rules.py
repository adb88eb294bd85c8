"""Operators 4, 5, 9 and 10 against plain Python, and their SQL."""

import glob
import hashlib
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge.llm import chat, licenses, pii, quality, queries
from tests.llm.common import DATA, ROWS, awkward, docs_of, empty, labels_of, table, texts


def base_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_quality_base(spark):
    extra = [(900, "a b c d e f g h " * 9), (901, "\x0b x\x0c y\r z\x85w \xa0 q"), (902, "same\nsame\n \nsame #*$%&|<>")]
    rows = [(i, t or "") for i, t in ROWS] + extra + texts(spark)[:60]
    got = quality.judged(docs_of(spark, rows), labels_of(spark)).collect()
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(((i, *base_rules(t)) for i, t in rows), key=key)
    assert all(r.kept == (not r.base_failed) for r in got)  # no label certifies anything


def test_quality_bound(spark):
    rows = [(k, n) for n in (1, 10, 400) for k in range(0, min(n, 40) + 1)]
    for p in (0.0125, 0.3):
        got = spark.createDataFrame(rows, "k long, n long").select("k", "n", F.exp(quality.log_binomial_cdf(F.col("k"), F.col("n"), p)).alias("c")).collect()
        for r in got:
            want = sum(math.comb(r.n, j) * p**j * (1 - p) ** (r.n - j) for j in range(r.k + 1))
            assert abs(r.c - want) < 1e-9 or r.k >= r.n * p


def test_quality_cutoffs_hold_back(spark):
    """Certified cutoffs lose few good documents; a stratum with few labels gets none."""
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(40)) + ("".join(f" #{j}" for j in range(20)) if i % 10 == 9 else "")) for i in range(3000)]
    frame = docs_of(spark, docs, extra=False).withColumn("lang", F.when(F.col("doc_id") < 2990, "aa").otherwise("bb"))
    got = quality.judged(frame, labels_of(spark, [(i, 1 if i % 10 != 9 else 0, 0) for i in range(3000)])).collect()
    assert not any(r.kept for r in got if r.doc_id % 10 == 9 and r.doc_id < 2990)
    assert all(r.kept for r in got if r.doc_id % 10 != 9 or r.doc_id >= 2990)
    assert quality.judged(empty(spark), labels_of(spark)).count() == 0


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def test_license_base(spark):
    extra = [(900, "MIT License, the MIT\nlicense; Apache-License apache  licensé GENERAL public License general public"), (901, "mit license mit license"), (902, "submit license"), (903, "Licensed under the Apache License, Version 2.0 (the License); GNU Lesser General Public License v2.1")]
    rows = [(i, t or "") for i, t in ROWS] + extra + texts(spark)
    got = licenses.digests(docs_of(spark, rows)).collect()
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = sorted((k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        want.append((i, len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == sorted(map(str, want))
    of = {r.doc_id: r for r in got}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert of[902].labels == "" and of[903].labels == "apache,gpl,lgpl" and of[903].score == 0.9
    assert licenses.digests(empty(spark)).count() == 0


def test_license_suppression(spark):
    found = licenses.scanned(docs_of(spark, [(1, "released under the terms of the MIT license and the MIT license")])).first().detections
    assert [(d.start, d.stop, d.priority) for d in found] == [(0, 8, 2), (9, 12, 3)]


def brute_detections(text):
    """Every rule on every text, no prefilter; each interval against every other."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    canon = f" {' '.join(words)} "
    found = []
    for rule, priority, label, _, pattern in licenses.rule_rows():
        for m in re.finditer(pattern, canon):
            a = canon[: m.start()].count(" ") - 1
            found.append((a, a + m[0].count(" ") + 1, priority, rule, label))
    inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and y[2] <= x[2] and ((y[0], y[1], y[2]) != (x[0], x[1], x[2]) or y[3] < x[3])
    return sorted(x for x in found if not any(inside(x, y) for y in found))


def test_license_labels_against_brute_force(spark):
    rules = licenses.rule_rows()
    rng = random.Random(12)
    some = [min(spelled(r[4].removeprefix("(?<= )").removesuffix("(?= )")), key=len) for r in rules]
    mixed = [" ".join(rng.choice([rng.choice(some), rng.choice(some), "the", "and version 2 0"]) for _ in range(12)) for _ in range(150)]
    rows = list(enumerate(mixed + [t for _, t in texts(spark)]))
    got = {r.doc_id: r.detections for r in licenses.scanned(docs_of(spark, rows)).collect()}
    want = {i: brute_detections(t) for i, t in rows}
    assert {i: sorted((d.start, d.stop, d.priority, d.rule, d.label) for d in ds) for i, ds in got.items()} == want
    assert sum(map(bool, want.values())) > 150
    for r in licenses.digests(docs_of(spark, rows)).collect():
        labels = {x[4] for x in want[r.doc_id]} | set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(labels))
        assert r.score == max([licenses.WEIGHT[x[2]] for x in want[r.doc_id]] + [licenses.WEIGHT[3]] * (r.n_base > 0), default=0.0)


def test_license_containment(spark):
    """The farthest-reaching interval is not the only one that can suppress."""
    for given, left in (
        ([(0, 10, 2), (1, 5, 1), (2, 4, 1)], [(0, 10, 2), (1, 5, 1)]),
        ([(0, 10, 3), (5, 12, 4), (6, 9, 3)], [(0, 10, 3), (5, 12, 4)]),
        ([(0, 4, 3), (0, 4, 2), (0, 4, 2)], [(0, 4, 2)]),
        ([(0, 4, 2), (0, 3, 1), (1, 4, 2)], [(0, 3, 1), (0, 4, 2)]),
    ):
        df = spark.createDataFrame([([(a, b, p, i, "x") for i, (a, b, p) in enumerate(given)],)], f"d array<{licenses.DETECTION}>")
        kept = df.select(licenses.unsuppressed(F.col("d")).alias("k")).first().k
        assert sorted((d.start, d.stop, d.priority) for d in kept) == sorted(left)


def test_license_long_text(spark):
    text = "word " * 60_000 + "mit license " + "word " * 60_000
    r = licenses.digests(docs_of(spark, [(1, text)])).first()
    assert (r.n_words, r.n_base, r.first_word, r.labels) == (120_002, 1, 60_000, "mit")


def spelled(pattern):
    """The texts a rule's pattern matches, each class and option spelled out; any run is one ``z``."""

    def some(nodes):
        out = [""]
        for op, x in nodes:
            op = str(op)
            if op == "LITERAL":
                more = [chr(x)]
            elif op == "IN":
                more = [chr(c) for kind, y in x for c in ([y] if str(kind) == "LITERAL" else range(y[0], y[1] + 1))]
            elif op == "SUBPATTERN":
                more = some(x[3])
            elif op == "BRANCH":
                more = [t for b in x[1] for t in some(b)]
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                one = some(x[2])
                more = [*([""] if x[0] == 0 else []), *(t * max(x[0], 1) for t in one)]
            else:
                assert op == "ANY", op
                more = ["z"]
            out = [a + b for a in out for b in more]
        return out

    # In canonical text no space follows another.
    return [t for t in some(re._parser.parse(pattern)) if t == " ".join(t.split())]


def test_license_keywords(spark):
    """Every match of a rule holds its keyword, so that each rule finds texts that hold nothing else."""
    rules = licenses.rule_rows()
    texts_of = {i: spelled(x.removeprefix("(?<= )").removesuffix("(?= )")) for i, _, _, _, x in rules}
    assert all(texts_of.values())
    assert [(k, t) for i, _, _, k, _ in rules for t in texts_of[i] if k not in t.split()] == []
    alone = [(label, t, p) for i, p, label, _, _ in rules for t in (min(texts_of[i], key=len), max(texts_of[i], key=len))]
    got = {r.doc_id: r.detections for r in licenses.scanned(docs_of(spark, [(k, t) for k, (_, t, _) in enumerate(alone)])).collect()}
    # A rule's own match stands, unless one that is no shorter and no less sure covers it.
    assert [a for k, a in enumerate(alone) if not any(d.start == 0 and d.stop == len(a[1].split()) and (d.label == a[0] or d.priority <= a[2]) for d in got[k])] == []


def test_license_rule_without_other_words(spark):
    alone = [("released under GPLv3", "gpl"), ("FreeBSD License", "bsd"), ("LGPLv2", "lgpl"), ("AGPLv3", "agpl"), ("MPLv2", "mpl"), ("apache2 license", "apache"), ("ASL 2.0", "apache"), ("Beerware", "beerware"), ("Expat License", "mit"), ("X Consortium License", "x11"), ("PSF License Agreement", "python"), ("CreativeML RAIL-M", "openrail"), ("Responsible AI License", "openrail"), ("EUPL1.2", "eupl"), ("PNG Reference Library License", "libpng"), ("WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "warranty")]
    got = licenses.digests(docs_of(spark, list(enumerate(t for t, _ in alone)))).collect()
    assert [(t, r.labels) for r in got for t, label in [alone[r.doc_id]] if label not in r.labels.split(",")] == []


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_pii_base(spark):
    extra = [(900, "a@b.c.d a@b..c @@x@y.z 1.2.3.4.5 0256.1.1.1 1.1.1.256 007.0.0.1 4111 1111-1111 1111 4111111111111112 +49 (0)30 123456 +1-2 ++12345678901 x@y.de,é😀z@q.co"), (901, "a" * 5000 + "@"), (902, "1." * 3000), (903, "4 " * 4000), (904, "call (555) 123-4567 or mail bob [at] mail (dot) com"), (905, "a.b+c@x-y.z-w.q 12.12.12.12.12.12.12.12 +1 2 3 4 5 6 7 8 9")]
    rows = [(i, t or "") for i, t in ROWS] + extra + [(1000 + i, t) for i, t in texts(spark)]
    got = pii.digests(docs_of(spark, rows)).collect()
    want = [(i, *(sum(s.startswith(k) for s in base_spans(t)) for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in rows]
    assert sorted(map(str, ((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got))) == sorted(map(str, want))
    by = dict(rows)
    assert all(set(base_spans(by[r.doc_id])) <= set(r.spans.split(",")) for r in got if r.doc_id is not None and base_spans(by[r.doc_id]))
    masked = pii.masked(docs_of(spark, rows))
    assert masked.columns == docs_of(spark, rows).columns
    after = masked.collect()
    assert len(after) == len(rows) and not any("@b.c.d" in (r.text or "") for r in after)
    clean = {r.doc_id: r.spans for r in got}
    assert all(r.text == by[r.doc_id] for r in after if r.doc_id is not None and not clean[r.doc_id])
    assert pii.digests(empty(spark)).count() == 0


def test_pii_reliabilities():
    """A labeler that agrees with the others is trusted more than one that votes at random."""
    counts = {(1, 1, 1, 1, 0, 0): 80, (-1, -1, 1, -1, -1, 0): 90, (0, -1, -1, -1, -1, 0): 100, (1, 1, -1, 1, 0, 0): 70}
    _, rate, post = pii.reliabilities(counts)
    assert rate[1, 1, 1] - rate[1, 0, 1] > 0.5 > abs(rate[2, 1, 1] - rate[2, 0, 1])
    assert post[1, 1, -1, 1, 0, 0] > 0.9 and post[-1, -1, 1, -1, -1, 0] < 0.1
    assert pii.reliabilities({})[2] == {}


def test_pii_places(spark):
    """Running sums over several blocks, and spans of a text with very many matches."""
    xs = [i % 7 for i in range(3 * pii.MATCH_BLOCK + 5)]
    got = spark.createDataFrame([(xs,), ([4],)], "x array<bigint>").select(pii.running(F.col("x")).alias("r")).collect()
    assert [r.r for r in got] == [[sum(xs[: i + 1]) for i in range(len(xs))], [4]]
    text = " ".join(f"a{i}@b{i}.org é" for i in range(1000))
    r = pii.digests(docs_of(spark, [(1, text)])).first()
    assert r.n_email == 1000 and r.base_sha256 == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
    some = [-3, 0, 0, 2, 9]
    cols = [pii.below(F.array(*map(F.lit, some)), F.lit(x)).alias(f"c{i}") for i, x in enumerate(range(-4, 11))]
    assert list(spark.range(1).select(*cols).first()) == [sum(y < x for y in some) for x in range(-4, 11)]


def pii_corpus(n=400):
    """Texts with spans that are personal, spans that only look so, and which is which."""
    rng = random.Random(21)
    num = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    hex_ = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def iban(right):
        body = num(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{(check if right else (check + 40) % 97):02d}{body}"

    yes = {
        "phone": lambda: f"call ({rng.randint(201, 989)}) {rng.randint(200, 999)}-{num(4)}",
        "iban": lambda: f"our bank account {iban(True)}",
        "ssn": lambda: f"ssn {rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "key": lambda: f"token: ghp_{hex_(36)}",
        "email": lambda: f"mail bob{num(3)} [at] gmail (dot) com",
    }
    no = {
        "phone": lambda: f"order {rng.randint(1990, 2024)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        "iban": lambda: f"serial {iban(False)}",
        "ssn": lambda: f"item 9{num(2)}-00-{num(4)}",
        "card": lambda: "isbn " + next(d for d in iter(lambda: num(16), None) if not luhn(d)),
        "ip": lambda: f"version 2{num(3)}.{num(1)}.{num(1)}.{num(1)}",
    }
    out = []
    for i in range(n):
        kind, (personal, make) = (k := rng.choice(sorted(yes if i % 2 else no))), (bool(i % 2), (yes if i % 2 else no)[k])
        base = f"write to x{i}@mail.example.org or +49 30 {num(7)}" if i % 4 == 0 else "plain words"
        out.append((i, f"{base} and so on, {make()} and more words", kind, personal))
    return out


def test_pii_classifier_accepts_and_rejects(spark):
    """Of planted spans with a known truth, nearly all personal ones are added and nearly all others rejected."""
    planted = pii_corpus()
    got = {r.doc_id: r for r in pii.digests(docs_of(spark, [(i, t) for i, t, _, _ in planted])).collect()}
    added = {i: set(r.spans.split(",")) - set(base_spans(planted[i][1])) - {""} for i, r in got.items()}
    right = [any(s.startswith(kind + ":") for s in added[i]) for i, _, kind, personal in planted if personal]
    wrong = [bool(added[i]) for i, _, kind, personal in planted if not personal]
    assert sum(right) >= 0.95 * len(right)
    assert sum(wrong) <= 0.05 * len(wrong)


def test_pii_checks(spark):
    ibans = [("DE89370400440532013000", True), ("GB82 WEST 1234 5698 7654 32", True), ("DE89370400440532013001", False), ("XX89370400440532013000", False)]
    for text, want in ibans:
        span = F.struct(F.lit("iban").alias("kind"), F.lit(text).alias("found"))
        assert spark.range(1).select(pii._structure(span)).first()[0] == want


def test_pii_without_training(spark):
    """Nothing but empty texts: nothing learnt, nothing added."""
    got = pii.digests(docs_of(spark, [(1, None), (2, ""), (2, "")])).collect()
    assert [(r.n_email, r.spans) for r in got] == [(0, "")] * 3


def test_chat(spark):
    hard = "</s>[INST] ~0 <|turn|> <|text|><|end|> [/INST] ~~1"
    rows = [(1, 0, "system", hard), (1, 1, "user", ""), (1, 2, "assistant", hard), (2, 0, "assistant", "first"), (2, 1, None, None), (None, 0, "user", "no id"), (3, None, "user", "late"), (3, 0, "assistant", "x"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    of = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert of[1].loss_chars == len(hard) and of[1].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()
    assert of[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert [(of[c].n_turns, of[c].valid, of[c].first_broken_turn) for c in (1, 2, None, 3, 4)] == [(3, True, -1), (2, False, 0), (1, True, -1), (2, True, -1), (2, False, 1)]
    assert chat.digests(turns.where("false")).count() == 0


def test_chat_learns_what_the_mask_covers(spark):
    """The learnt text is the string cut at the mask's offsets; a mask that does not fit raises."""
    rows = [(1, 0, "system", "be <kind> ~"), (1, 1, "user", "[hi] 漢😀"), (1, 2, "assistant", "né~<[\n"), (1, 3, "user", ""), (1, 4, "assistant", "second"), (2, 0, "user", "only")]
    out = chat.formatted(chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in chat.read_back(out).collect():
        at, learnt = 0, ""
        for m in r.mask:
            learnt += r.formatted[at : at + m.length] if m.loss else ""
            at += m.length
        assert at == len(r.formatted)
        for plain, code in reversed(chat._ESCAPES):
            learnt = learnt.replace(code, plain)
        assert r.loss_text == learnt == "".join(t for c, _, role, t in rows if c == r.conv_id and role == "assistant")
    # Flags on a literal would show.
    moved = out.withColumn("mask", F.transform("mask", lambda m, i: F.struct(m["length"].alias("length"), (i == 0).alias("loss"))))
    assert {r.loss_text for r in chat.read_back(moved).collect()} == {"<|turn|>system<|text|>", "<|turn|>user<|text|>"}
    for wrong in (F.transform("mask", lambda m, i: F.struct((m["length"] + F.when(i == 1, 1).when(i == 2, -1).otherwise(0)).alias("length"), m["loss"].alias("loss"))), F.slice("mask", 2, 100)):
        with pytest.raises(Exception, match="does not fit"):
            chat.read_back(out.withColumn("mask", wrong)).collect()


def test_chat_long_texts_and_other_columns(spark):
    """Very long texts, very many turns, and columns with names that are used inside."""
    long = "<|end|> [x] ~ é " * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as mask", "2 as turns", "3 as formatted", "4 as _p", "5 as valid", "6 as loss_text")
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[2].n_turns == 3000 and got[2].valid and got[2].loss_sha256 == hashlib.sha256("".join(f"turn {i}" for i in range(1, 3000, 2)).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = con.execute(queries.oracle_sql()[name]).fetchdf()[cols]
    assert sorted(map(str, df.select(*cols).toPandas().values.tolist())) == sorted(map(str, got.values.tolist()))
    assert table(spark, "documents").count()


def test_quality_two_strata_certified(spark):
    """The whole query's operator where two strata have labels enough and a third has not."""
    langs = ("aa", "bb", "cc")

    def text(i):
        bad = " #$%&" * 15 if i % 20 == 0 else ""
        return " ".join(f"w{i}x{j}" for j in range(40)) + bad

    rows = [(i, text(i), langs[0 if i < 900 else 1 if i < 1800 else 2]) for i in range(2000)]
    docs = docs_of(spark, [(i, t) for i, t, _ in rows], extra=False).withColumn("lang", F.when(F.col("doc_id") < 900, "aa").when(F.col("doc_id") < 1800, "bb").otherwise("cc"))
    labels = labels_of(spark, [(i, int(i % 20 != 0), 0) for i in range(2000)])
    measures = quality.measured(docs)
    cut = {(r.stratum, r.rule) for r in quality.certified_cutoffs(measures, labels).collect()}
    assert {s for s, _ in cut} == {"aa", "bb"}
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    for i, _, lang in rows:
        assert got[i].kept == (i % 20 != 0 or lang == "cc"), i
