"""Multi-modal combination: per-modality confidences -> contributions, boost,
primary modality, usage statistics. Inputs are columns of confidences
(text, images, audio, documents; null = modality absent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketscope.functions.text import words

# Modality weights.
MODALITY_WEIGHTS = [("text", 0.6), ("images", 0.25), ("audio", 0.1), ("documents", 0.05)]


def mm_combine_text(*texts: Column) -> Column:
    """Texts of all modalities joined by a space (absent ones skipped), stripped."""
    return F.trim(F.concat_ws(" ", *texts), F.lit(" "))


def mm_text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    from ticketscope.functions.text import txt_clean, txt_stopwords
    t = F.col(text_col)
    return df.select("*", txt_stopwords(txt_clean(t)).alias("processed_text"), F.length(t).alias("length"),
                     F.size(words(t)).alias("word_count"))


def mm_contributions(df: DataFrame, conf_cols: dict[str, str]) -> DataFrame:
    """Normalised weighted contributions and the primary modality (ties -> order)."""
    w = {m: F.coalesce(F.col(conf_cols[m]), F.lit(0.0)) * wt if m in conf_cols else F.lit(0.0)
         for m, wt in MODALITY_WEIGHTS}
    total = sum(w.values(), F.lit(0.0))
    out = df
    for m, _ in MODALITY_WEIGHTS:
        out = out.withColumn(f"contrib_{m}", F.when(total > 0, w[m] / total).otherwise(w[m]))
    cands = [F.struct(F.col(f"contrib_{m}").alias("w"), F.lit(-i).alias("o"), F.lit(m).alias("m"))
             for i, (m, _) in enumerate(MODALITY_WEIGHTS)]
    return out.withColumn("primary_modality", F.greatest(*cands)["m"])


def mm_confidence_boost(base: Column, confs: list[Column]) -> Column:
    """+0.1 per further modality with confidence > 0.3, at most +0.2, capped at 1."""
    n = sum((F.coalesce(c, F.lit(0.0)) > 0.3).cast("int") for c in confs)
    return F.when(n > 1, F.least(F.lit(1.0), base + F.least(F.lit(0.2), (n - 1) * 0.1))).otherwise(base)


def mm_classify(df: DataFrame, conf_cols: dict[str, str], *, prediction_col: str | None = None,
                confidence_col: str | None = None, text_col: str = "text") -> DataFrame:
    """Combine a text prediction with modality evidence. Without text the
    prediction is 'General Inquiry' at 0.1."""
    has_text = F.col(text_col).isNotNull() & (F.length(F.trim(F.col(text_col), F.lit(" "))) > 0)
    pred = F.col(prediction_col) if prediction_col else F.lit(None).cast("string")
    base = F.col(confidence_col) if confidence_col else F.lit(None).cast("double")
    d = df.withColumn("predicted_category", F.when(has_text, pred).otherwise(F.lit("General Inquiry"))) \
        .withColumn("base_confidence", F.when(has_text, base).otherwise(F.lit(0.1)))
    d = mm_contributions(d, conf_cols)
    confs = [F.col(c) for c in conf_cols.values()]
    d = d.withColumn("confidence", mm_confidence_boost(F.col("base_confidence"), confs))
    used = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0.0)) > 0, F.lit(m))
                                     for m, c in conf_cols.items()]))
    return d.withColumn("modalities_used", used)


def mm_classify_model(df: DataFrame, model, conf_cols: dict[str, str], *, text_cols: list[str]) -> DataFrame:
    """``mm_classify`` with a fitted pipeline (``ml_train_pipeline``): the texts of
    all modalities are joined, the model gives category and confidence, and the
    other modalities' confidences boost it. A row without any text is 'General
    Inquiry' at 0.1; repeated rows stay."""
    from ticketscope.operators.ml import ml_predict_batch
    joined = df.withColumn("combined_text", mm_combine_text(*[F.col(c) for c in text_cols]))
    scored = ml_predict_batch(model, joined, text_col="combined_text", with_prob_columns=False).drop("probabilities")
    scored = scored.withColumnsRenamed({"predicted_category": "model_category", "confidence": "model_confidence"})
    return mm_classify(scored, conf_cols, prediction_col="model_category", confidence_col="model_confidence",
                       text_col="combined_text")


def agg_modality_usage(df: DataFrame, *, has_text: Column, has_images: Column, has_audio: Column,
                       has_documents: Column) -> DataFrame:
    """Counts with images / audio / documents; text-only counts text alone (quirk 13)."""
    n = has_text.cast("int") + has_images.cast("int") + has_audio.cast("int") + has_documents.cast("int")
    return df.agg(F.count("*").alias("total_processed"), F.count_if(has_images).alias("with_images"),
                  F.count_if(has_audio).alias("with_audio"), F.count_if(has_documents).alias("with_documents"),
                  F.count_if(has_text & (n == 1)).alias("text_only"), F.count_if(n > 1).alias("multi_modal"))
