"""Token counts through an exact histogram of encoded lengths.

Documents are encoded once and counted by length. Every later question
(total, quantile, tokens left after truncation to a context limit) is answered
from prefix and suffix sums over the histogram, never from the texts again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import cut, map_arrow
from ticketscope.llm.tokens import VOCABULARY, encoder, vocabulary

#: Lengths per block of the two-level sums; a block is one window partition.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, vocab: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of every row; a null or empty text has 0 tokens."""
    data = vocabulary(docs.sparkSession, vocab)

    def run(batch: pa.RecordBatch):
        enc = encoder(data.value)
        yield {"doc_id": batch.column("doc_id"),
               "n_tokens": [len(enc.encode_ordinary(x)) if x else 0 for x in batch.column("text").to_pylist()]}

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"),
                     run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: counted in the tasks before the shuffle, so a length
    that a third of the documents share is one row per task."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def sums(hist: DataFrame) -> DataFrame:
    """One row per length that occurs, each read as a context limit.

    ``docs_upto``/``tokens_upto``: documents of at most that length and their
    tokens; ``docs_from``/``tokens_from``: suffix sums, the length itself
    included; ``truncated_total``: tokens left when every document is cut to
    that length; ``n_cut``: documents that lose tokens; ``share_upto``: the
    quantile rank of the length. Two-level sums: blocks of ``BLOCK`` lengths
    are totalled, the totals (one row per block) are summed, and each block
    adds its own running sum. An empty corpus gives no row.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn(
        "n_sum", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_sum").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"),
        F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"))
    own = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    r = (h.join(blocks, "block")
         .withColumn("docs_upto", F.col("d0") + F.sum("n_docs").over(own))
         .withColumn("tokens_upto", F.col("t0") + F.sum("n_sum").over(own))
         .withColumn("docs_from", F.col("all_docs") - F.col("docs_upto") + F.col("n_docs"))
         .withColumn("tokens_from", F.col("all_tokens") - F.col("tokens_upto") + F.col("n_sum"))
         .withColumn("n_cut", F.col("all_docs") - F.col("docs_upto")))
    return r.select(
        "n_tokens", "n_docs", "docs_upto", "tokens_upto", "docs_from", "tokens_from", "n_cut",
        (F.col("tokens_upto") + F.col("n_tokens") * F.col("n_cut")).alias("truncated_total"),
        (F.col("docs_upto") / F.col("all_docs")).alias("share_upto"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Truncated totals for any context limits, whether or not a document has
    that length: ``context, truncated_total, n_cut``. A limit of 0 keeps none."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    one = hist.agg(F.array(*[F.struct(
        F.lit(int(c)).cast("long").alias("context"),
        F.coalesce(F.sum(F.least(n, F.lit(int(c))) * d), F.lit(0)).alias("truncated_total"),
        F.coalesce(F.sum(F.when(n > int(c), d)), F.lit(0)).alias("n_cut")) for c in limits]).alias("a"))
    return one.select(F.inline("a"))


def quantiles(suffix: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length that at least the share of the documents does not exceed:
    ``share, n_tokens`` (null for an empty corpus)."""
    one = suffix.agg(F.array(*[F.struct(
        F.lit(float(s)).alias("share"),
        F.min(F.when(F.col("share_upto") >= float(s), F.col("n_tokens"))).alias("n_tokens"))
        for s in shares]).alias("a"))
    return one.select(F.inline("a"))


def token_report(docs: DataFrame, vocab: str = VOCABULARY) -> DataFrame:
    """Histogram and sums of ``docs`` (doc_id, text). Repeated rows count each;
    null ids count; other columns are ignored."""
    return sums(cut(histogram(encoded_lengths(docs, vocab))))  # two branches read the counts
