"""From raw documents to token ids: quality, near duplicates, benchmark items, personal data, tokens.

Every stage takes a table of documents with doc_id and text, whatever other columns it has, under any names, and reads it more than once: it must
be a table or checkpoint, as `run` gives. All but the last return the same columns. Rows that repeat others are rows of their own unless a stage says
otherwise, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textsig.llm import bpe, leaks, near, pii, quality
from textsig.llm.shared import documents, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: of quality, and not toxic.

    A row is judged by its text alone, so rows that repeat a text stay or go together. A null or empty text is judged by the constant term that all texts
    have, like the plainest labelled documents; a null doc_id makes no difference; without labels all stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: that with the least doc_id; of rows with the same doc_id or none, the first row.

    Rows that repeat a doc_id and text count as copies. Rows with a null text, or one without words, all stay; rows without a doc_id stay only if
    no row of their group has one."""
    return near.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with a tenth of its characters changed at most.

    A null or empty text holds none; a null doc_id makes no difference; null items, and those without words, are in no text."""
    return leaks.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked by its kind in angle brackets. A null or empty text stays as it is."""
    return pii.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their tokens in place of their texts: tokens, n_tokens, exact (whether they decode to the very text), which take the place of
    columns of these names. A null text has null in all three, an empty one no tokens."""
    return bpe.with_tokens(docs, [c for c in docs.columns if c not in ("text", "tokens", "n_tokens", "exact")])


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("PII", mask_personal_data),
    ("byte-level BPE", tokenise),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
