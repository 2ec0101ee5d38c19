"""From raw documents to tokens: quality, near-duplicates, benchmark leaks, personal data, byte-level BPE.

Each stage is written as Parquet in the shared folder and read again as the input of the next. All but the last
return the columns of documents; documents that a stage rejects are gone, personal data are replaced in the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm import bpe, decontamination, near_dedup, pii, quality
from orbweave.llm.common import cut, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored by their statistics like any other;
    equal rows stay or go together; without labels a fixed curve decides."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles at 0.8, that with the smallest id. Texts without
    words, null ones among them, are near to nothing and stay; of equal rows one stays."""
    return near_dedup.keep_one(docs, 5)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and empty texts stay; equal rows stay or go together."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by their kind. Null texts stay null; no row goes."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's token ids and of what they decode to, a row for each row. A null text counts as empty."""
    return bpe.token_digests(docs)


STAGES = [
    ("quality", good_documents),
    ("near_dedup", distinct_documents),
    ("decontamination", clean_of_benchmarks),
    ("pii", without_personal_data),
    ("bpe", tokens),
]

#: No SQL can express the classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`. Texts of any length count whole in each, columns of any name come through up to the last
    stage, and an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, name)
    return docs
