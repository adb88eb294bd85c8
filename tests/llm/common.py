"""Documents for the tests: a small table with every awkward case, and the test data."""

import os

DATA = os.environ.get("LLM_TEST_DATA", "/root/testdata/sf0.001")
#: Extra columns whose names clash with those that operators use inside.
EXTRA = ("start", "length", "offset", "sig", "keys", "node", "bucket", "root", "ids", "score", "kept", "base", "loose", "h", "_text", "_id", "_words", "stratum", "item_id", "part")
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
SAME = "the quick brown fox jumps over the lazy dog while seven wizards box with jelly in the old mill by the river"
ROWS = [(1, None), (2, ""), (3, LONG), (4, SAME), (5, SAME), (5, SAME), (6, " \n\t "), (7, "x"), (None, SAME + " again"), (8, "Ünï İ ça 漢字　 text\n\n\nend \n"), (9, None)]


def docs_of(spark, rows, extra=True):
    data = [(i, t, None, "s", None if t is None else len(t), *([-1] * len(EXTRA) if extra else [])) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + ("".join(f", `{c}` int" for c in EXTRA) if extra else "")
    return spark.createDataFrame(data, schema)


def awkward(spark):
    return docs_of(spark, ROWS)


def empty(spark):
    return docs_of(spark, [])


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality long, toxic long")


def texts(spark):
    return [(r.doc_id, r.text or "") for r in table(spark, "documents").select("doc_id", "text").collect()]
