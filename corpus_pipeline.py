"""Corpus pipeline: documents to training-order shards of token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketscope.llm.common import shared_table, table
from ticketscope.llm.mixing import mix
from ticketscope.llm.pu import keep_good
from ticketscope.llm.simhash import keep_one
from ticketscope.llm.tiling import drop_contaminated
from ticketscope.llm.training_order import materialise

#: Share of expected tokens by domain after mixing; toxic and poor text is never raised above what is there.
TARGETS = {"good": 0.97, "toxic": 0.02, "poor": 0.01}
ORDER_KEY = "corpus-order-1"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 2 bits)."""
    return keep_one(docs, shingle=3, max_bits=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item (tiles of 5 words, 0.8 of the item covered)."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_match=5, min_coverage=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their mixing rate says: good ones once or more."""
    return mix(docs, table(spark, sf_dir, "labels"), TARGETS, at_most=("toxic", "poor"))


def training_order_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids in training order."""
    return materialise(docs, ORDER_KEY)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("training_order", training_order_stage),
]

#: SQL expresses neither the classifiers nor the encoding; the tests hold each
#: stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
