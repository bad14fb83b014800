"""All feature groups of a text in one sparse vector, standardised without
filling it: a row keeps its nonzero entries over the deviations, and the scaler
keeps the one shift (mean over deviation) that all rows share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.operators.features import (DOMAIN_FEATURES, STAT_FEATURES, ft_domain, ft_sentiment_lexicon, ft_statistical,
                                            txt_tfidf_pruned)
from ticketscope.session import materialize

SENTIMENT_FEATURES = ["sentiment_score", "positive_count", "neutral_count", "negative_count"]


def group_features(df: DataFrame, *, id_col: str, text_col: str, max_features: int = 10000, ngram_range=(1, 3),
                   topics: DataFrame | None = None, topics_col: str = "topic_distribution") -> DataFrame:
    """``(id, grp, feature, value)``, nonzero values only: TF-IDF terms, 13
    statistics, 12 domain patterns, 4 sentiment values, and the topic shares when
    ``topics`` (``id_col`` and a numeric array) is given. Null texts count as
    empty; ids are taken as unique."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    tfidf = txt_tfidf_pruned(docs, id_col="id", text_col="t", max_features=max_features, ngram_range=ngram_range).select(
        F.col("doc_id").alias("id"), F.lit("tfidf").alias("grp"), F.col("term").alias("feature"), F.col("tfidf").alias("value"))
    dense = ft_sentiment_lexicon(ft_domain(ft_statistical(docs, "t"), "t"), "t")
    named = [(g, n) for g, group in (("statistical", STAT_FEATURES), ("domain", DOMAIN_FEATURES), ("sentiment", SENTIMENT_FEATURES))
             for n in group]
    rest = dense.select("id", F.explode(F.array(*[
        F.struct(F.lit(g).alias("grp"), F.lit(n).alias("feature"), F.col(n).alias("value")) for g, n in named])).alias("f")).select(
        "id", "f.*")
    out = tfidf.unionByName(rest)
    if topics is not None:
        out = out.unionByName(topics.select(F.col(id_col).alias("id"), F.posexplode(topics_col).alias("i", "value")).select(
            "id", F.lit("topics").alias("grp"), F.format_string("topic_%02d", "i").alias("feature"),
            F.col("value").cast("double").alias("value")))
    return out.where(F.col("value") != 0)


@dataclass(frozen=True)
class Scaler:
    """One row per feature (grp, feature, index, mean, std); population deviation, 1 where it is 0."""

    table: DataFrame
    n: int

    def shift_norm(self) -> Column:
        """Squared length of the shared shift, as a scalar subquery."""
        return self.table.select(F.coalesce(F.sum((F.col("mean") / F.col("std")) ** 2), F.lit(0.0))).scalar()


def fit_scaler(features: DataFrame, n: int) -> Scaler:
    """Mean and population deviation of each feature over ``n`` documents: the
    absent values are zeros, so count, mean and spread of the present ones
    suffice. Features are numbered by group and name."""
    here = F.count("*").cast("double")
    g = features.groupBy("grp", "feature").agg(here.alias("c"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    share = F.col("c") / F.lit(float(max(n, 1)))
    # spread within the present values plus that between them and the zeros
    var = share * F.col("v") + share * (1 - share) * F.col("m") * F.col("m")
    std = F.sqrt(var)
    g = g.select("grp", "feature", (share * F.col("m")).alias("mean"),
                 F.when(std > 1e-12 * F.abs("m"), std).otherwise(F.lit(1.0)).alias("std"))
    # at most the vocabulary and the fixed features: a bounded array numbers them
    order = F.array_sort(F.collect_list(F.struct("grp", "feature", "mean", "std")))
    table = g.agg(order.alias("f")).select(F.posexplode("f").alias("index", "f")).select("f.grp", "f.feature", "index", "f.mean", "f.std")
    return Scaler(materialize(table), n)


def scale(features: DataFrame, scaler: Scaler) -> DataFrame:
    """``(id, idx, val, sq_norm)``: the nonzero entries over their deviations, and
    the squared length of the row standardised in full. The standardised value at
    ``i`` is ``val - mean / std`` (val 0 where absent). A feature that the scaler
    does not hold is left out."""
    # one row per feature of a bounded vocabulary: safe to broadcast
    j = features.join(F.broadcast(scaler.table), ["grp", "feature"]).select(
        "id", "index", (F.col("value") / F.col("std")).alias("val"), (F.col("mean") / F.col("std")).alias("off"))
    entries = F.array_sort(F.collect_list(F.struct("index", "val")))
    change = F.sum(F.col("val") * F.col("val") - 2 * F.col("val") * F.col("off"))
    return j.groupBy("id").agg(entries.alias("e"), change.alias("d")).select(
        "id", F.col("e.index").alias("idx"), F.col("e.val").alias("val"), (F.col("d") + scaler.shift_norm()).alias("sq_norm"))


def ft_assemble_all(df: DataFrame, *, id_col: str, text_col: str, max_features: int = 10000, ngram_range=(1, 3),
                    topics: DataFrame | None = None, topics_col: str = "topic_distribution") -> tuple[DataFrame, Scaler]:
    """Features of every group, assembled and standardised: the sparse rows and the
    scaler. A document always has a row: one without any nonzero feature keeps an
    empty one."""
    features = materialize(group_features(df, id_col=id_col, text_col=text_col, max_features=max_features,
                                          ngram_range=ngram_range, topics=topics, topics_col=topics_col))
    scaler = fit_scaler(features, df.count())
    rows = df.select(F.col(id_col).alias("id")).join(scale(features, scaler), "id", "left").select(
        "id", F.coalesce("idx", F.array().cast("array<int>")).alias("idx"),
        F.coalesce("val", F.array().cast("array<double>")).alias("val"), F.coalesce("sq_norm", scaler.shift_norm()).alias("sq_norm"))
    return rows, scaler
