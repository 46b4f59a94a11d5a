"""The corpus pipeline: quality, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with their own columns; the
last one gives the packed pieces. ``run`` writes each stage's result as Parquet into the shared
folder and reads it again, so that a lost executor repeats one stage at most.

Defined results: a null text counts as empty in every decision and stays null until packing, where it is
the end alone. Rows with a null doc_id are judged like others, never linked and never cut against themselves.
Of rows that share a doc_id, those of equal word sets count once in near-duplicates, the smallest text first;
others stay. Ties between groups go to the smallest doc_id. Very long texts are read whole; packing
spreads them over as many sequences as they need. Further columns of the documents pass through to packing.
An empty table gives no pieces; without labels of both classes no document is rejected that the share of
label 1 (0.5 without labels) keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pubmart.llm import chunks, near_dups, packing, pii, quality
from pubmart.llm.common import staged, table
from pubmart.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dups.distinct_documents(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return chunks.without_repeats(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences."""
    return packing.packed(docs, tokenizer_path(packing.VOCABULARY))


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_distinct),
    ("substring dedup", cut_repeats),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: Learned scores and hashed candidates have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
