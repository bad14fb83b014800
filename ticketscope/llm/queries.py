"""Registered queries of the operators: each applies one to its whole table.

``ORACLES`` holds DuckDB SQL for the queries that SQL can express.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketscope.llm.alignment import align_tokenizers
from ticketscope.llm.common import table
from ticketscope.llm.html_tree import extract
from ticketscope.llm.lengths import token_report
from ticketscope.llm.licenses import scan_licenses
from ticketscope.llm.mixing import mixing_rates
from ticketscope.llm.outliers import quality_rules
from ticketscope.llm.pu import quality
from ticketscope.llm.repeats import find_repeats
from ticketscope.llm.runs import periodic_runs
from ticketscope.llm.secrets import scan_secrets
from ticketscope.llm.simhash import digest, near_duplicates
from ticketscope.llm.tiling import contaminated
from ticketscope.llm.training_order import materialise

#: Key of the registered training order.
ORDER_KEY = "corpus-order-1"


def op1_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2))


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"))


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"), length=100).drop("spans")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), ORDER_KEY)


def op10_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op11_sync_set_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), least=12, plant=True, lists=False)


def op12_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), lists=False)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), with_groups=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mcd_quality_rules, op2_soft_mixing, op3_simhash_near_dedup, op4_length_histogram, op5_string_tiling, op6_pu_quality, op7_license_scan,
        op8_bucket_pointer_dedup, op9_training_order, op10_html_tree, op11_sync_set_runs, op12_secret_automaton,
        op13_tokenizer_alignment)
}
ORACLES: dict[str, str] = {}
