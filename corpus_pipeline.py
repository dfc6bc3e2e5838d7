"""From raw documents to tokens, in five stages.

Each stage works on all its predecessor kept, which was written as Parquet and
read again. All but the last return the columns of ``documents``.

Rows with NULL or empty text are rejected by the first stage, as are texts
without a letter and texts that no learned language claims. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import configure
from plumbline.llm import bpe, decontaminate, exact_dedup, jaccard, language_id
from plumbline.llm.common import prepare, stored, table
from plumbline.llm.queries import BYTE_BPE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language can be told, with that as their ``lang``; trained on their own labels."""
    prepare(configure(spark))
    model = language_id.train(docs)
    return language_id.keep_claimed(docs, model, language_id.claim_limits(docs, model))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest id."""
    prepare(configure(spark))
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-grams at a similarity of 0.8."""
    prepare(configure(spark))
    return jaccard.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    prepare(configure(spark))
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document, and whether they decode to its text."""
    prepare(configure(spark))
    named = docs.select("doc_id", "lang", "source", "text")
    encoded = bpe.encode(named, BYTE_BPE, keep=("doc_id", "lang", "source", "text"), offsets=False)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return bpe.decode(encoded, BYTE_BPE).select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenize),
]

# Code lengths and encoding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
