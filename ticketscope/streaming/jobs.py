"""Structured Streaming: ingest, classify, monitor, alert, learn.

Every stream is ``readStream -> transformations -> writeStream`` with a
checkpoint location, so offsets, state and sink commits survive restarts
and executor loss. Per-micro-batch logic runs in ``foreachBatch`` and
writes one output folder per ``batch_id`` (overwrite), which makes a
replayed batch idempotent.
"""

from __future__ import annotations

import os
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from ticketscope.constants import STREAM_BATCH_SIZE
from ticketscope.operators.cooldown import NEVER, kept_events
from ticketscope.schemas import STREAM_MESSAGE
from ticketscope.session import checkpoint_dir

LOW_CONFIDENCE = 0.7
DRIFT_SHARE = 0.3
ESCALATE_BELOW = 0.5


def scratch(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory (never machine-local on a cluster)."""
    base = checkpoint_dir(spark)
    return os.path.join(base.replace("file:", ""), name)


# ------------------------------------------------------------ decode / encode

def decode_messages(df: DataFrame, *, value_col: str = "value", offset_col: str | None = "offset",
                    channel: str = "kafka", id_prefix: str = "kafka_") -> DataFrame:
    """JSON messages -> tickets (src_kafka / src_ws_messages).

    Defaults: ticket_id ``<prefix><offset>``, priority ``medium``; rows with
    invalid JSON or without ``customer_message`` become error rows
    (``error`` not null) instead of failing the batch.
    """
    raw = F.col(value_col).cast("string")
    schema = StructType(list(STREAM_MESSAGE.fields) + [StructField("_corrupt_record", StringType())])
    parsed = F.from_json(raw, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    d = df.withColumn("_m", parsed).withColumn("_raw", raw)
    bad_json = F.col("_m").isNull() | F.col("_m._corrupt_record").isNotNull() | ~F.ltrim(F.col("_raw")).startswith("{")
    missing = F.col("_m.customer_message").isNull()
    default_id = (F.concat(F.lit(id_prefix), F.col(offset_col).cast("string")) if offset_col
                  else F.concat(F.lit(id_prefix), F.expr("uuid()")))  # unique within a batch, too
    err = (F.when(bad_json, F.lit("Invalid JSON format"))
           .when(missing, F.lit("Missing required field: 'customer_message'")))
    keep = [c for c in df.columns if c not in (value_col,)]
    return d.select(*keep,
                    F.coalesce(F.col("_m.ticket_id"), default_id).alias("ticket_id"),
                    F.col("_m.customer_message").alias("customer_message"),
                    F.coalesce(F.col("_m.priority"), F.lit("medium")).alias("priority"),
                    F.lit(channel).alias("channel"),
                    F.col("_m.customer_id").alias("customer_id"),
                    F.coalesce(F.col("_m.metadata"), F.create_map().cast("map<string,string>")).alias("metadata"),
                    err.alias("error"))


def encode_results(df: DataFrame, key_col: str = "ticket_id") -> DataFrame:
    """Result rows -> (key, value) for a Kafka sink (snk_kafka)."""
    return df.select(F.col(key_col).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def kafka_source(spark: SparkSession, servers: str, topic: str = "support_tickets") -> DataFrame:
    """Kafka stream -> tickets (requires the spark-sql-kafka connector on the class path)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return decode_messages(raw, value_col="value", offset_col="offset")


def kafka_sink(results: DataFrame, servers: str, checkpoint: str, topic: str = "ticket_results"):
    return (encode_results(results).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).start())


# ----------------------------------------------------------------- classify

def st_classify(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], *,
                escalate_below: float = ESCALATE_BELOW, escalation: Column | None = None) -> DataFrame:
    """Score tickets and flag escalation (confidence < 0.5, or the response rule)."""
    scored = scorer(df)
    esc = F.col("confidence") < escalate_below
    if escalation is not None:
        esc = esc | escalation
    return scored.withColumn("escalation_required", esc)


def batch_monitor(batch: DataFrame, *, batch_col: str | None = None) -> DataFrame:
    """st_batch_monitor + st_batch_drift for one or many batches: size, mean
    confidence, mean processing time, low-confidence share, drift flag
    (>= 5 rows and > 30 % below 0.7)."""
    keys = [batch_col] if batch_col else []
    g = batch.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"),
        F.avg("processing_time_ms").alias("avg_processing_time_ms"),
        F.avg((F.col("confidence") < LOW_CONFIDENCE).cast("int")).alias("low_confidence_rate"))
    return g.withColumn("drift_detected", (F.col("n") >= 5) & (F.col("low_confidence_rate") > DRIFT_SHARE))


def flag_drift(batch: DataFrame, monitor: DataFrame, *, batch_col: str, order: list[str], last: int = 5) -> DataFrame:
    """Mark the last ``last`` rows of drifting batches (win_last5_of_batch)."""
    w = Window.partitionBy(batch_col).orderBy(*[F.desc(c) for c in order])
    r = batch.withColumn("_r", F.row_number().over(w))
    m = monitor.select(batch_col, F.col("drift_detected").alias("_batch_drift"))
    return r.join(m, batch_col, "left").withColumn(
        "drift_detected", F.coalesce(F.col("_batch_drift"), F.lit(False)) & (F.col("_r") <= last)).drop("_r", "_batch_drift")


def flag_drift_of_batch(batch: DataFrame, monitor: DataFrame, *, order: list[str], last: int = 5) -> DataFrame:
    """``flag_drift`` for one micro-batch: its last rows come from a top-k over all
    tasks and are joined back by row number, so no task ranks the batch. ``batch``
    holds ``_rid`` (distinct row numbers) and is persisted; ``monitor`` has one row."""
    tail = batch.orderBy(*[F.desc(c) for c in order], F.desc("_rid")).limit(last).select("_rid", F.lit(True).alias("_last"))
    drift = monitor.select(F.col("drift_detected")).scalar()
    return batch.join(F.broadcast(tail), "_rid", "left").withColumn(
        "drift_detected", F.coalesce(drift, F.lit(False)) & F.coalesce("_last", F.lit(False))).drop("_rid", "_last")


def run_classification_stream(spark: SparkSession, source: DataFrame, scorer, *, out_path: str,
                              checkpoint: str, callbacks: list[Callable] | None = None,
                              processing_time: str | None = None, order: list[str] | None = None):
    """Start the stream: classify in each micro-batch, compute the batch
    monitor and drift flags BEFORE emitting, write results per batch_id.
    ``callbacks`` get (result_df, batch_id) (st_callbacks)."""
    order = order or ["ts"]

    def per_batch(bdf: DataFrame, batch_id: int):
        res = st_classify(bdf, scorer).withColumn("batch_id", F.lit(batch_id)).withColumn("_rid", F.monotonically_increasing_id())
        res = res.persist()
        mon = batch_monitor(res.drop("_rid"), batch_col="batch_id")
        flagged = flag_drift_of_batch(res, mon, order=order)
        flagged.write.mode("overwrite").parquet(os.path.join(out_path, "results", f"batch_id={batch_id}"))
        mon.write.mode("overwrite").parquet(os.path.join(out_path, "monitor", f"batch_id={batch_id}"))
        for cb in callbacks or []:
            cb(flagged, batch_id)
        res.unpersist()

    # per-micro-batch stream statistics in StreamingQueryProgress.observedMetrics
    # (st_stats: rows, mean confidence / processing time), computed by Spark
    observed = source.observe("stream_input", F.count(F.lit(1)).alias("rows"))
    w = observed.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start()


# ------------------------------------------------------- windowed metrics

def st_windowed_metrics(stream: DataFrame, *, window: str = "1 hour", slide: str = "10 minutes",
                        watermark: str = "1 hour") -> DataFrame:
    """Sliding per-model metrics with a watermark (event time must be TIMESTAMP)."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return s.groupBy(F.window("ts", window, slide).alias("w"), "model_name").agg(
        F.count("*").alias("n"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"),
        F.avg("confidence").alias("avg_confidence"), F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg((F.col("predicted_class") == "Error").cast("int")).alias("error_rate"))


def st_dedupe_late(stream: DataFrame, *, key: list[str], watermark: str = "1 hour") -> DataFrame:
    """Drop duplicate keys arriving within the watermark (event time)."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return s.dropDuplicatesWithinWatermark(key)


# ---------------------------------------------------------- alert cooldown

ALERT_STATE = StructType([StructField("last_ts", TimestampType())])


def st_alert_cooldown(alerts: DataFrame, *, cooldown_minutes: int = 60, state_ttl: bool = False) -> DataFrame:
    """Cooldown as keyed stream state: per (alert_type, model_name) the time of
    the last KEPT alert. State is one timestamp per key (alert types x
    models). ``state_ttl`` expires idle keys after the cooldown (for
    continuously running queries; an ``availableNow`` run needs it off)."""
    gap = int(cooldown_minutes * 60_000_000)
    out_schema = StructType([StructField(f.name, TimestampType() if f.name == "ts" else f.dataType)
                             for f in alerts.schema.fields])

    def fn(key, pdfs, state):
        last = state.get[0] if state.exists else None
        kept = []
        # a key's alerts of one micro-batch may come in several Arrow chunks, in
        # any order: they are put in time order together, then only the kept ones are visited
        chunks = [x for x in pdfs if len(x)]
        if chunks:
            pdf = pd.concat(chunks).sort_values("ts", kind="stable")
            at = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
            before = NEVER if last is None else int(np.datetime64(pd.Timestamp(last).to_datetime64(), "us").astype(np.int64))
            own = kept_events(at, np.zeros(len(at), bool), gap, before)
            kept = [pdf.iloc[own]]
            last = pd.Timestamp(pdf["ts"].iloc[own[-1]]).to_pydatetime() if len(own) else last
        if state_ttl and state.hasTimedOut:
            state.remove()
            return
        if last is not None:
            state.update((last,))
            if state_ttl:
                state.setTimeoutDuration(cooldown_minutes * 60 * 1000)
        for k in kept:
            if len(k):
                yield k

    a = alerts.withColumn("ts", F.col("ts").cast("timestamp"))
    return a.groupBy("alert_type", "model_name").applyInPandasWithState(
        fn, outputStructType=out_schema, stateStructType=ALERT_STATE, outputMode="append",
        timeoutConf="ProcessingTimeTimeout" if state_ttl else "NoTimeout")


# ------------------------------------------------- incremental naive Bayes

def nb_tokens(text: Column) -> Column:
    from ticketscope.functions.text import TOKEN2_RE
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN2_RE), 0)


def nb_counts(feedback: DataFrame, *, text_col: str = "text", label_col: str = "true_category") -> DataFrame:
    """Additive multinomial NB state: (class, term, n) plus (class, '', docs)."""
    t = feedback.select(F.col(label_col).alias("class"), F.explode(nb_tokens(F.col(text_col))).alias("term"))
    terms = t.groupBy("class", "term").agg(F.count("*").alias("n"))
    docs = feedback.groupBy(F.col(label_col).alias("class")).agg(F.count("*").alias("n")).withColumn("term", F.lit(""))
    return terms.unionByName(docs)


def st_feedback_updates(spark: SparkSession, feedback_stream: DataFrame, *, state_path: str, checkpoint: str,
                        text_col: str = "text", label_col: str = "true_category"):
    """Merge each micro-batch's NB counts into the state table.

    Each batch writes its delta under ``batch_id=N`` (overwrite = idempotent
    replay); the model is the sum of all deltas (``nb_model``).
    """
    def per_batch(bdf: DataFrame, batch_id: int):
        nb_counts(bdf, text_col=text_col, label_col=label_col).write.mode("overwrite").parquet(
            os.path.join(state_path, f"batch_id={batch_id}"))

    return (feedback_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def nb_model(spark: SparkSession, state_path: str) -> DataFrame:
    return spark.read.parquet(state_path).groupBy("class", "term").agg(F.sum("n").alias("n"))


def ol_incremental_model(counts: DataFrame, docs: DataFrame, *, id_col: str, text_col: str,
                         alpha: float = 1.0) -> DataFrame:
    """Score documents with the NB counts: argmax_c log P(c) + sum log P(t|c).

    Token x class scores come from an equi-join of exploded tokens with the
    (term, class) table; unseen terms get the Laplace floor per class. A document
    without tokens (null text included) is scored by the class priors alone.
    """
    priors = counts.where(F.col("term") == "").select("class", F.col("n").alias("docs"))
    terms = counts.where(F.col("term") != "")
    tot = terms.groupBy("class").agg(F.sum("n").alias("total"))
    vocab = terms.select(F.countDistinct("term")).scalar()
    ndocs = priors.select(F.sum("docs")).scalar()
    cls = priors.join(tot, "class", "left").select(  # a class whose documents had no token keeps its prior
        "class", F.ln(F.col("docs") / ndocs).alias("log_prior"),
        (F.coalesce("total", F.lit(0)) + alpha * vocab).alias("denom"))
    toks = docs.select(F.col(id_col).alias("doc_id"), F.explode(nb_tokens(F.col(text_col))).alias("term"))
    tf = toks.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    known = tf.join(terms.select("term", "class", F.col("n").alias("cnt")), "term")
    seen = known.groupBy("doc_id", "class").agg(
        F.sum(F.col("tf") * (F.ln(F.col("cnt") + alpha) - F.ln(F.lit(alpha)))).alias("_seen"))
    # each document is scored for every class: the class table (one row per
    # class) travels as a scalar array, exploded per document - no join
    classes = cls.select(F.collect_list(F.struct("class", "log_prior", "denom"))).scalar()
    n_tokens = F.greatest(F.coalesce(F.size(nb_tokens(F.col(text_col))), F.lit(0)), F.lit(0))
    dl = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.sum(n_tokens).alias("len"))
    base = dl.select("doc_id", "len", F.explode(classes).alias("c")).select("doc_id", "len", "c.*")
    s = base.join(seen, ["doc_id", "class"], "left")
    floor = F.when((F.col("len") > 0) & (F.col("denom") > 0),
                   F.col("len") * (F.ln(F.lit(alpha)) - F.ln(F.col("denom")))).otherwise(F.lit(0.0))
    score = F.col("log_prior") + floor + F.coalesce(F.col("_seen"), F.lit(0.0))
    s = s.withColumn("score", score)
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "class")
    return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
        "doc_id", F.col("class").alias("predicted_category"), "score")


# --------------------------------------------------------------- UDF hook

def udf_score_hook(fn: Callable[[pd.Series], pd.DataFrame]) -> Callable[[Column], Column]:
    """Wrap an external model ``texts -> DataFrame[predicted_category, confidence]``
    as an Arrow-batched pandas UDF returning a struct column."""
    rtype = StructType([StructField("predicted_category", StringType()),
                        StructField("confidence", DoubleType())])

    @F.pandas_udf(rtype)
    def _score(texts: pd.Series) -> pd.DataFrame:
        out = fn(texts)
        return out[["predicted_category", "confidence"]]

    return _score


__all__ = ["decode_messages", "encode_results", "kafka_source", "kafka_sink", "st_classify", "batch_monitor",
           "flag_drift", "flag_drift_of_batch", "run_classification_stream", "st_windowed_metrics", "st_dedupe_late",
           "st_alert_cooldown", "nb_counts", "st_feedback_updates", "nb_model", "ol_incremental_model",
           "udf_score_hook", "scratch"]
