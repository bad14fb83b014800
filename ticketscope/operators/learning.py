"""Active learning and online learning over a feedback table.

Feedback schema: id, ts, text, predicted_category, true_category,
confidence, user_id. Everything is grouped aggregation; cumulative
statistics are computed on per-day aggregates (a window over days, not
over rows), so no single task ever sees the raw feedback stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.operators._util import as_of_col, epoch_micros
from ticketscope.operators.windows import top_n_per_group, win_top_users

UPDATE_EVERY = 50


def _correct():
    return F.col("predicted_category") == F.col("true_category")


def al_record_feedback(df: DataFrame) -> DataFrame:
    """Add ``was_correct`` and the ``predicted -> correct`` pattern key."""
    return (df.withColumn("was_correct", _correct())
            .withColumn("error_pattern", F.when(~_correct(), F.concat_ws(" -> ", "predicted_category",
                                                                          "true_category"))))


def al_feedback_accuracy(fb: DataFrame) -> DataFrame:
    return fb.agg(F.coalesce(F.avg(_correct().cast("int")), F.lit(0.0)).alias("feedback_accuracy"),
                  F.count("*").alias("total_feedback"))


def al_error_patterns(fb: DataFrame, *, as_of=None, recent_days: int = 7, samples: int = 5) -> DataFrame:
    """Per ``predicted -> correct`` pattern: count, first samples, mean confidence,
    recent count, overconfident flag (mean confidence > 0.8)."""
    t = as_of_col(fb, as_of)
    err = fb.where(~_correct()).withColumn("pattern", F.concat_ws(" -> ", "predicted_category", "true_category"))
    recent = F.floor((epoch_micros(t) - epoch_micros(F.col("ts")))
                     / F.lit(86_400_000_000)) <= recent_days
    g = err.groupBy("pattern", "predicted_category", "true_category").agg(
        F.count("*").alias("count"), F.avg("confidence").alias("avg_confidence"),
        F.count_if(recent).alias("recent_occurrences"))
    cut = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text"))
    firsts = top_n_per_group(err.withColumn("_t", cut), "pattern", [F.col("ts"), F.col("id")], samples, "_r")
    smp = firsts.groupBy("pattern").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t"))), lambda s: s["_t"]).alias("sample_texts"))
    return (g.join(smp, "pattern").withColumn("overconfident", F.col("avg_confidence") > 0.8))


def al_retrain_strategy(fb: DataFrame, *, min_samples: int = 50) -> DataFrame:
    """One row: should_retrain and the triggered strategies."""
    pat = (fb.where(~_correct()).groupBy("predicted_category", "true_category").agg(F.count("*").alias("c"))
           .select(F.struct("c", "predicted_category", "true_category").alias("k")))
    top = pat.select(F.max("k").alias("k"))
    imbalance = (fb.groupBy("true_category").agg(F.count("*").alias("c"))
                 .select((F.max("c") / F.min("c")).alias("r")).scalar())
    # one-row aggregates combined through scalar subqueries, not joins
    j = fb.agg(F.count("*").alias("n"), F.avg(_correct().cast("int")).alias("acc")).select(
        "n", "acc", top.select(F.col("k.c")).scalar().alias("top_count"),
        top.select(F.concat_ws(" from ", "k.predicted_category", "k.true_category")).scalar().alias("top_pattern"),
        imbalance.alias("imbalance"))
    enough = F.col("n") >= min_samples
    strategies = F.filter(F.array(
        F.when(F.col("top_count") >= 5, F.concat(F.lit("focused_retraining: Focus on distinguishing "),
                                                 F.col("top_pattern"))),
        F.when(F.col("imbalance") > 3, F.lit("balance_training_data: Address class imbalance in training data")),
        F.when(F.col("acc") < 0.8, F.lit("general_retraining: Improve overall model performance"))),
        lambda x: x.isNotNull())
    strategies = F.when(enough, strategies).otherwise(F.array().cast("array<string>"))
    return j.select((enough & (F.size(strategies) > 0)).alias("should_retrain"),
                    F.array_join(strategies, " | ").alias("strategies"),
                    F.col("acc").alias("feedback_accuracy"), F.col("n").alias("total_feedback_samples"))


def al_improvement(fb: DataFrame) -> DataFrame:
    """``min(0.15 * high-confidence errors / errors, 1 - accuracy)``; 0 without errors."""
    err = ~_correct()
    return fb.agg(F.count_if(err).alias("errors"),
                  F.count_if(err & (F.col("confidence") > 0.8)).alias("hc_errors"),
                  F.avg(_correct().cast("int")).alias("acc")).select(
        F.when(F.col("errors") == 0, F.lit(0.0)).otherwise(
            F.least(F.col("hc_errors") / F.col("errors") * 0.15, 1 - F.col("acc"))).alias("estimated_improvement"))


def al_diverse(candidates: DataFrame, *, max_samples: int = 20, seed: int = 42) -> DataFrame:
    """K-means (k <= 20) on 6 raw features of uncertain samples; most uncertain per cluster.

    Input: text_id, text, uncertainty_score, confidence.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    f = candidates.select(
        "*", F.length("text").cast("double").alias("f_len"),
        F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("double").alias("f_words"),
        F.regexp_count("text", F.lit(r"\?")).cast("double").alias("f_q"),
        F.regexp_count("text", F.lit("!")).cast("double").alias("f_e"))
    feats = ["f_len", "uncertainty_score", "confidence", "f_words", "f_q", "f_e"]
    vec = VectorAssembler(inputCols=feats, outputCol="features").transform(f)
    n = vec.count()
    if n <= max_samples:  # every candidate is a cluster of its own; same columns as below
        return candidates.withColumn("cluster", F.lit(None).cast("int"))
    model = KMeans(k=max_samples, seed=seed, featuresCol="features", predictionCol="cluster").fit(vec)
    clustered = model.transform(vec)
    best = top_n_per_group(clustered, "cluster", [F.desc("uncertainty_score"), F.col("text_id")], 1, "_r")
    return best.select(*candidates.columns, "cluster")


# ------------------------------------------------------------ online learner

def ol_feedback_summary(fb: DataFrame, *, as_of=None, days: int = 7) -> DataFrame:
    """Per true category in the last N days: count and accuracy."""
    t = as_of_col(fb, as_of)
    d = fb.where(F.col("ts") > t - F.make_dt_interval(F.lit(days)))
    return d.groupBy("true_category").agg(F.count("*").alias("count"),
                                          (F.count_if(_correct()) / F.count("*")).alias("accuracy"))


def win_top_feedback_users(fb: DataFrame, *, as_of=None, days: int = 7, n: int = 10) -> DataFrame:
    t = as_of_col(fb, as_of)
    return win_top_users(fb.where(F.col("ts") > t - F.make_dt_interval(F.lit(days))), user_col="user_id", n=n)


def ol_daily_stats(fb: DataFrame, *, update_every: int = UPDATE_EVERY) -> DataFrame:
    """Cumulative learner statistics at the end of each day.

    feedback_received and correct are running sums over per-day counts;
    model_updates = floor(feedback / update_every); current_accuracy =
    correct feedback / feedback (decision for quirk 10).
    """
    day = fb.groupBy(F.to_date("ts").alias("date")).agg(
        F.count("*").alias("n"), F.count_if(_correct()).alias("ok"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    cum = day.select("date", F.sum("n").over(w).alias("feedback_received"),
                     F.sum("ok").over(w).alias("correct_predictions"))
    return cum.select("date", "feedback_received", "correct_predictions",
                      F.floor(F.col("feedback_received") / update_every).cast("long").alias("model_updates"),
                      (F.col("correct_predictions") / F.col("feedback_received")).alias("current_accuracy"))


def win_learning_trend(fb: DataFrame, *, as_of=None, days: int = 30) -> DataFrame:
    t = as_of_col(fb, as_of)
    s = ol_daily_stats(fb)
    return s.where(F.col("date") > F.to_date(t - F.make_dt_interval(F.lit(days)))).orderBy("date")


def ol_stats(fb: DataFrame, preds: DataFrame | None = None, *, update_every: int = UPDATE_EVERY) -> DataFrame:
    """Totals: predictions, correct feedback, feedback, updates, accuracy."""
    f = fb.agg(F.count("*").alias("feedback_received"), F.count_if(_correct()).alias("correct_predictions"))
    if preds is not None:
        f = f.withColumn("total_predictions", preds.select(F.count("*")).scalar())
    return f.select("*", F.floor(F.col("feedback_received") / update_every).cast("long").alias("model_updates"),
                    F.try_divide(F.col("correct_predictions"), F.col("feedback_received")).alias("current_accuracy"))


def ol_low_confidence(preds: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    return preds.where(F.col("confidence") < threshold)
