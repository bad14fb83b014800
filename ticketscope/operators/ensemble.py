"""Ensemble voting over a long vote table ``(text_id, model, prediction, confidence)``.

One shuffle on ``text_id``: the per-text weight total, the per-(text,
class) scores and the per-text arg-max all reuse that partitioning (a
hash partitioning on text_id satisfies the clustering on (text_id,
class)). Model history enters through a per-model table (one row per
model), which the planner broadcasts when it is small.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.operators.windows import win_last_n

DEFAULT_HIST_ACC = 0.5
HIGH_CONFIDENCE = 0.7


def ens_model_weights(history: DataFrame | None, *, last_n: int = 3) -> DataFrame | None:
    """Mean accuracy of each model's last ``last_n`` evaluations (decision for quirk 7)."""
    if history is None:
        return None
    recent = win_last_n(history, group="model", ts="ts", n=last_n)
    return recent.groupBy("model").agg(F.avg("accuracy").alias("hist_accuracy"))


def ens_class_scores(votes: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(text_id, prediction, score, n_votes): normalised weighted vote per class."""
    v = votes
    hist = ens_model_weights(history)
    if hist is not None:
        v = v.join(hist, "model", "left")
    else:
        v = v.withColumn("hist_accuracy", F.lit(None).cast("double"))
    v = v.withColumn("w", F.col("confidence") * (1 + F.coalesce("hist_accuracy", F.lit(DEFAULT_HIST_ACC))))
    tot = F.sum("w").over(Window.partitionBy("text_id"))
    v = v.withColumn("wn", F.when(tot > 0, F.col("w") / tot).otherwise(F.col("w")))
    return v.groupBy("text_id", "prediction").agg(F.sum("wn").alias("score"), F.count("*").alias("n_votes"))


def ens_weighted_vote(votes: DataFrame, history: DataFrame | None = None,
                      *, high_confidence: float = HIGH_CONFIDENCE) -> DataFrame:
    """Per text: ensemble prediction (ties alphabetical), confidence, class scores,
    agreement (modal vote share) and the high-confidence flag."""
    s = ens_class_scores(votes, history)
    g = s.groupBy("text_id").agg(
        F.min_by("prediction", F.struct(-F.col("score"), F.col("prediction"))).alias("ensemble_prediction"),
        F.max("score").alias("ensemble_confidence"),
        (F.max("n_votes") / F.sum("n_votes")).alias("agreement_score"),
        F.sum("n_votes").alias("n_models"),
        F.map_from_entries(F.collect_list(F.struct("prediction", "score"))).alias("ensemble_probabilities"))
    g = g.withColumn("agreement_score", F.when(F.col("n_models") <= 1, F.lit(1.0)).otherwise(F.col("agreement_score")))
    return g.withColumn("high_confidence", F.col("ensemble_confidence") > high_confidence)


def ens_agreement(votes: DataFrame) -> DataFrame:
    """Share of models voting for the modal class (1.0 with <= 1 model)."""
    c = votes.groupBy("text_id", "prediction").agg(F.count("*").alias("n"))
    g = c.groupBy("text_id").agg((F.max("n") / F.sum("n")).alias("agreement_score"), F.sum("n").alias("m"))
    return g.select("text_id", F.when(F.col("m") <= 1, F.lit(1.0)).otherwise(F.col("agreement_score"))
                    .alias("agreement_score"))


def ens_batch(votes: DataFrame, texts: DataFrame, history: DataFrame | None = None,
              *, id_col: str = "text_id") -> DataFrame:
    """Every text gets a row: texts without any vote fall back to Error / 0.0."""
    res = ens_weighted_vote(votes, history)
    out = texts.select(F.col(id_col).alias("text_id")).join(res, "text_id", "left")
    return out.select("text_id",
                      F.coalesce("ensemble_prediction", F.lit("Error")).alias("ensemble_prediction"),
                      F.coalesce("ensemble_confidence", F.lit(0.0)).alias("ensemble_confidence"),
                      F.coalesce("agreement_score", F.lit(0.0)).alias("agreement_score"),
                      F.coalesce("high_confidence", F.lit(False)).alias("high_confidence"))


def ens_evaluate(results: DataFrame, labels: DataFrame, *, threshold: float = HIGH_CONFIDENCE,
                 label_col: str = "true_label") -> DataFrame:
    """Accuracy, mean confidence, accuracy and count of high-confidence rows."""
    j = results.join(labels, "text_id")
    ok = (F.col("ensemble_prediction") == F.col(label_col)).cast("int")
    hi = F.col("ensemble_confidence") > threshold
    return j.agg(F.avg(ok).alias("accuracy"), F.avg("ensemble_confidence").alias("average_confidence"),
                 F.coalesce(F.avg(F.when(hi, ok)), F.lit(0.0)).alias("high_confidence_accuracy"),
                 F.count_if(hi).alias("high_confidence_samples"))


def ens_class_report(results: DataFrame, labels: DataFrame, *, label_col: str = "true_label") -> DataFrame:
    """The evaluation's classification report: precision, recall, F1 and support per
    class with macro and weighted averages."""
    from ticketscope.operators.ml import ev_class_report
    return ev_class_report(results.join(labels, "text_id"), label_col=label_col, pred_col="ensemble_prediction")


def win_model_rankings(history: DataFrame, *, last_n: int = 3) -> DataFrame:
    """Rank models by 0.7 * mean accuracy + 0.3 * mean confidence of the last 3."""
    recent = win_last_n(history, group="model", ts="ts", n=last_n)
    g = recent.groupBy("model").agg(F.avg("accuracy").alias("average_accuracy"),
                                    F.avg("confidence").alias("average_confidence"))
    total = history.groupBy("model").agg(F.count("*").alias("evaluations"))
    g = g.join(total, "model").withColumn("score", F.col("average_accuracy") * 0.7 + F.col("average_confidence") * 0.3)
    return g.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("score"))))


def snk_append_model_history(history: DataFrame, new_rows: DataFrame, *, keep: int = 10) -> DataFrame:
    """Append evaluation rows and keep the newest ``keep`` per model."""
    return win_last_n(history.unionByName(new_rows), group="model", ts="ts", n=keep).drop("recency_rank")


# ------------------------------------------------------------ uncertainty

def al_uncertainty(votes: DataFrame, history: DataFrame | None = None, *, eps: float = 1e-10) -> DataFrame:
    """Entropy (scipy-style renormalised, natural log), max probability, mean
    one-hot vote variance, disagreement and the combined score, per text."""
    s = ens_class_scores(votes, history)
    w = Window.partitionBy("text_id")
    s = (s.withColumn("_S", F.sum(F.col("score") + eps).over(w))
          .withColumn("_m", F.sum("n_votes").over(w)))
    pk = (F.col("score") + eps) / F.col("_S")
    q = F.col("n_votes") / F.col("_m")
    g = s.groupBy("text_id").agg(
        (-F.sum(pk * F.ln(pk))).alias("entropy"),
        F.max("score").alias("max_probability"),
        F.avg(q * (1 - q)).alias("_var"),
        (F.max("n_votes") / F.first("_m")).alias("_agree"),
        F.first("_m").alias("_models"))
    var = F.when(F.col("_models") > 1, F.col("_var")).otherwise(F.lit(0.0))
    agree = F.when(F.col("_models") > 1, F.col("_agree")).otherwise(F.lit(1.0))
    g = g.select("text_id", "entropy", "max_probability", var.alias("prediction_variance"),
                 (1 - agree).alias("disagreement"))
    return g.withColumn("combined_uncertainty", F.col("entropy") * 0.4 + (1 - F.col("max_probability")) * 0.3
                        + F.col("prediction_variance") * 0.3)


def al_select(uncertainty: DataFrame, *, strategy: str = "combined", threshold: float = 0.8,
              n_classes: int = 7) -> DataFrame:
    """Uncertain samples for review, most uncertain first."""
    if strategy == "entropy":
        score, cond = F.col("entropy"), F.col("entropy") > math.log(n_classes) * 0.7
    elif strategy == "confidence":
        score, cond = 1 - F.col("max_probability"), F.col("max_probability") < threshold
    elif strategy == "disagreement":
        score, cond = F.col("disagreement"), F.col("disagreement") > 0.3
    elif strategy in ("combined", "diverse"):
        score, cond = F.col("combined_uncertainty"), F.col("combined_uncertainty") > 0.5
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return (uncertainty.where(cond).withColumn("uncertainty_score", score)
            .withColumn("needs_review", F.lit(True)).orderBy(F.desc("uncertainty_score"), "text_id"))
