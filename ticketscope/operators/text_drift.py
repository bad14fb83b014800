"""Reference features of texts for drift checks: TF-IDF of the reference
sample, its principal components, standardised. All state is bounded by the
vocabulary; current texts pass through the same state."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.operators.aggs import agg_common_words, agg_text_ref_stats, reference_stats
from ticketscope.operators.features import documents_tokens, fit_vocabulary, smooth_idf, vocabulary_rows
from ticketscope.operators.sparse_pca import SparsePca, apply_sparse_pca, fit_sparse_pca
from ticketscope.session import materialize


@dataclass(frozen=True)
class TextReference:
    """Fitted features: the vocabulary (term, index, idf) and the components."""

    vocabulary: DataFrame
    pca: SparsePca

    def save(self, spark: SparkSession, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.pca.save(spark, f"{path}/components")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TextReference":
        return TextReference(spark.read.parquet(f"{path}/vocabulary"), SparsePca.load(spark, f"{path}/components"))


def _weights(toks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Unit-length TF-IDF rows (id, idx, val) of tokenised documents with a known term."""
    return vocabulary_rows(toks, vocabulary, "idf").select(F.col("doc_id").alias("id"), "idx", "val")


def fit_text_reference(df: DataFrame, *, id_col: str, text_col: str, max_features: int = 5000, k: int = 100,
                       ngram_range=(1, 2)) -> TextReference:
    """Vocabulary and components of the reference texts (null texts count as empty)."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    n = docs.count()
    toks = documents_tokens(docs, id_col="id", text_col="t")  # kept: read for the vocabulary and for the rows
    fitted = fit_vocabulary(toks, ngram_range=ngram_range, max_features=max_features)
    vocabulary = materialize(fitted.select("term", "index", smooth_idf(n).alias("idf")))
    rows = materialize(_weights(toks, vocabulary))
    return TextReference(vocabulary, fit_sparse_pca(rows, size=max(1, vocabulary.count()), k=k, n=n))


def text_features(df: DataFrame, ref: TextReference, *, id_col: str, text_col: str, ngram_range=(1, 2)) -> DataFrame:
    """``id`` and ``features``: the components' coordinates over their population
    deviation in the reference (1 where that is 0). Texts without a known term
    are the zero vector's image; one row per id."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t"))
    rows = _weights(documents_tokens(docs, id_col="id", text_col="t"), ref.vocabulary)
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    full = docs.select("id").join(rows, "id", "left").select(
        "id", F.coalesce("idx", none[0]).alias("idx"), F.coalesce("val", none[1]).alias("val"))
    std = np.sqrt(ref.pca.variance * (ref.pca.n - 1) / max(ref.pca.n, 1))
    scale = F.array(*[F.lit(float(s) if s > 1e-12 else 1.0) for s in std])
    return apply_sparse_pca(full, ref.pca).select(
        "id", F.zip_with("pca", scale, lambda x, s: x / s).alias("features"))


def melt_features(features: DataFrame, *, array_col: str = "features") -> DataFrame:
    """(feature, value) rows; features are named by their position."""
    return features.select(F.posexplode(array_col).alias("i", "value")).select(
        F.format_string("f%03d", "i").alias("feature"), "value")


def fit_reference(df: DataFrame, *, id_col: str, text_col: str, label_col: str | None = None, max_features: int = 5000,
                  k: int = 100) -> tuple[TextReference, DataFrame, DataFrame]:
    """All reference state: the fitted features, the per-feature statistics (mean,
    deviation, range, percentiles; and per label its count, as features
    ``label=...``), and the text statistics with the 100 most common words."""
    ref = fit_text_reference(df, id_col=id_col, text_col=text_col, max_features=max_features, k=k)
    stats = reference_stats(melt_features(text_features(df, ref, id_col=id_col, text_col=text_col)))
    if label_col is not None:
        labels = df.groupBy(F.col(label_col).alias("l")).agg(F.count("*").cast("double").alias("mean"))
        stats = stats.unionByName(labels.select(F.concat(F.lit("label="), F.coalesce("l", F.lit("null"))).alias("feature"), "mean"),
                                  allowMissingColumns=True)
    words = agg_common_words(df, text_col).agg(F.array_sort(F.collect_list(F.struct(F.negate("count").alias("n"), "word"))).alias("w"))
    texts = agg_text_ref_stats(df, text_col).withColumn("common_words", words.select(F.col("w.word")).scalar())
    return ref, stats, texts
