"""Corpus pipeline: classify, fold near duplicates, decontaminate, mask personal data, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet into the shared folder and reads it back as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from spanforge.llm import classifier, decontaminate, neardup, packing, pii
from spanforge.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark, docs, sf_dir):
    """Drops the documents that the classifier rejects."""
    verdicts = classifier.scored(docs, classifier.train(docs, table(spark, sf_dir, "labels")), COLUMNS, text_column=True)
    return verdicts.where("kept").select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each class."""
    return neardup.deduplicated(docs.select(*COLUMNS))


def decontamination(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Replaces spans of personal data by their kind; n_chars follows the text."""
    return pii.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark, docs, sf_dir):
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: No SQL counterpart: training, ProbMinHash classes and tokenising are checked against brute force in the tests.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
    return docs
