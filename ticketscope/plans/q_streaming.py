"""Streaming queries. Each registered callable runs a Structured Streaming
query to completion (``availableNow``) over the given tables used as a file
stream, then returns the sink's table; the batch twins are oracle-checked."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ticketscope.operators import monitor as M
from ticketscope.operators._util import epoch_micros
from ticketscope.operators.drift import running_totals
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query
from ticketscope.streaming import jobs as P

Q = []


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def _fresh(s, name):
    return P.scratch(s, f"stream-{name}-{uuid.uuid4().hex}")


def _events_stream(s, sf, files: int = 4):
    """events as a file stream: staged into a folder of ``files`` files (the
    file source reads directories), one file per micro-batch."""
    stage = _fresh(s, "events")
    s.read.parquet(f"{sf}/events.parquet").repartition(files).write.parquet(stage)
    schema = s.read.parquet(stage).schema
    return s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(stage)


def _fixture_scorer(df):
    """The fixture's classifier: the same derivation as v_predictions."""
    k = F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)
    pred = F.when(F.col("event_type") == "error", F.lit("Error")).otherwise(F.col("event_type"))
    return df.select(F.col("event_id").alias("ticket_id"), "ts", pred.alias("predicted_category"),
                     k.alias("confidence"), F.col("value").alias("processing_time_ms"))


def _classify(s, sf):
    base = _fresh(s, "classify")
    q = P.run_classification_stream(s, _events_stream(s, sf), _fixture_scorer, out_path=base,
                                    checkpoint=os.path.join(base, "_checkpoint"), order=["ts", "ticket_id"])
    q.awaitTermination()
    return s.read.parquet(os.path.join(base, "results")).select(
        "ticket_id", "predicted_category", "confidence", "escalation_required")


reg("st_classify", _classify,
    "SELECT id AS ticket_id, predicted_class AS predicted_category, confidence, confidence < 0.5 AS escalation_required "
    "FROM v_predictions", ["v_predictions"], ["confidence"])


def _callbacks(s, sf):
    base = _fresh(s, "callbacks")
    seen = []
    q = P.run_classification_stream(s, _events_stream(s, sf), _fixture_scorer, out_path=base,
                                    checkpoint=os.path.join(base, "_checkpoint"),
                                    callbacks=[lambda df, bid: seen.append(bid)])
    q.awaitTermination()
    mon = s.read.parquet(os.path.join(base, "monitor"))
    # the callbacks saw every batch exactly once: both counts are in the result
    return mon.agg(F.sum("n").alias("processed"), F.countDistinct("batch_id").alias("batches"),
                   F.lit(len(seen)).cast("long").alias("calls"), F.lit(len(set(seen))).cast("long").alias("batches_called"))


reg("st_callbacks", _callbacks,
    "SELECT count(*) AS processed, CAST(4 AS BIGINT) AS batches, CAST(4 AS BIGINT) AS calls, "
    "CAST(4 AS BIGINT) AS batches_called FROM events")  # 4 staged files, 1 per trigger


def _twin(s, sf):
    """Batch twin of the micro-batcher: global event order, 10 rows per batch."""
    e = _fixture_scorer(s.read.parquet(f"{sf}/events.parquet"))
    e = e.withColumn("_k", F.lit(0)).withColumn("_o", F.struct("ts", "ticket_id"))
    r = running_totals(e.withColumn("_one", F.lit(1.0)), key="_k", order="_o", cols=["_one"])
    return r.withColumn("batch", F.floor((F.col("rank") - 1) / 10)).drop("_k", "_o", "_one", "cum__one")


TWIN_SQL = """tw AS (SELECT id AS ticket_id, ts, confidence, latency_ms AS processing_time_ms,
                         floor((row_number() OVER (ORDER BY ts, id) - 1) / 10) AS batch FROM v_predictions),
mon AS (SELECT batch, count(*) AS n, avg(confidence) AS avg_confidence, avg(processing_time_ms) AS avg_processing_time_ms,
               avg(CAST(confidence < 0.7 AS INTEGER)) AS low_confidence_rate FROM tw GROUP BY batch)"""


def _microbatch(s, sf):
    return P.batch_monitor(_twin(s, sf), batch_col="batch")


reg("st_microbatch", _microbatch,
    f"WITH {TWIN_SQL} SELECT *, n >= 5 AND low_confidence_rate > 0.3 AS drift_detected FROM mon",
    ["v_predictions"], ["avg_confidence", "avg_processing_time_ms", "low_confidence_rate"])
reg("st_batch_monitor", lambda s, sf: _microbatch(s, sf).agg(F.count("*").alias("batches"),
                                                             F.avg("avg_confidence").alias("mean_batch_confidence")),
    f"WITH {TWIN_SQL} SELECT count(*) AS batches, avg(avg_confidence) AS mean_batch_confidence FROM mon",
    ["v_predictions"], ["mean_batch_confidence"])


def _batch_drift(s, sf):
    t = _twin(s, sf)
    f = P.flag_drift(t, P.batch_monitor(t, batch_col="batch"), batch_col="batch", order=["ts", "ticket_id"])
    return f.where("drift_detected").select("batch", "ticket_id")


reg("st_batch_drift", _batch_drift,
    f"""WITH {TWIN_SQL},
    r AS (SELECT batch, ticket_id, row_number() OVER (PARTITION BY batch ORDER BY ts DESC, ticket_id DESC) AS r FROM tw)
    SELECT r.batch, r.ticket_id FROM r JOIN mon USING (batch)
    WHERE n >= 5 AND low_confidence_rate > 0.3 AND r.r <= 5""", ["v_predictions"])


def _cooldown_stream(s, sf):
    from ticketscope.plans.q_monitor import q_checks
    base = _fresh(s, "cooldown")
    alerts = q_checks(s, sf)
    alerts.write.parquet(os.path.join(base, "alerts"))
    src = s.readStream.schema(s.read.parquet(os.path.join(base, "alerts")).schema).parquet(os.path.join(base, "alerts"))
    out = P.st_alert_cooldown(src, cooldown_minutes=60)
    q = (out.writeStream.format("parquet").option("path", os.path.join(base, "kept"))
         .option("checkpointLocation", os.path.join(base, "_checkpoint")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return s.read.parquet(os.path.join(base, "kept")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _cooldown_sql():
    from ticketscope.plans.q_monitor import COOLDOWN_SQL
    return COOLDOWN_SQL


reg("st_alert_cooldown", _cooldown_stream, _cooldown_sql(), ["v_predictions"], ("current_value", "threshold"))


def _feedback_nb(s, sf):
    base = _fresh(s, "nb")
    fb = spark_view(s, sf, "v_feedback")
    fb.write.parquet(os.path.join(base, "feedback"))
    src = s.readStream.schema(s.read.parquet(os.path.join(base, "feedback")).schema).option(
        "maxFilesPerTrigger", 2).parquet(os.path.join(base, "feedback"))
    q = P.st_feedback_updates(s, src, state_path=os.path.join(base, "state"),
                              checkpoint=os.path.join(base, "_checkpoint"))
    q.awaitTermination()
    return P.nb_model(s, os.path.join(base, "state"))


NB_SQL = """SELECT class, term, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT true_category AS class, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term, 1 AS n FROM v_feedback
  UNION ALL SELECT true_category, '', 1 FROM v_feedback) GROUP BY 1, 2"""
reg("st_feedback_updates", _feedback_nb, NB_SQL, ["v_feedback"])


def _nb_scores(s, sf):
    counts = P.nb_counts(spark_view(s, sf, "v_feedback"))
    docs = spark_view(s, sf, "v_predictions").select("id", F.col("input_text").alias("text"))
    return P.ol_incremental_model(counts, docs, id_col="id", text_col="text").groupBy("predicted_category").count()


NB_SCORE_SQL = """WITH counts AS (""" + NB_SQL + """),
priors AS (SELECT class, n AS docs FROM counts WHERE term = ''),
terms AS (SELECT * FROM counts WHERE term <> ''),
tot AS (SELECT class, sum(n) AS total FROM terms GROUP BY 1),
vs AS (SELECT count(DISTINCT term) AS v FROM terms),
nd AS (SELECT sum(docs) AS nd FROM priors),
cls AS (SELECT p.class, ln(CAST(docs AS DOUBLE) / nd) AS log_prior, coalesce(total, 0) + 1.0 * v AS denom
        FROM priors p LEFT JOIN tot USING (class), vs, nd),
toks AS (SELECT id AS doc_id, unnest(regexp_extract_all(lower(input_text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM v_predictions),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
seen AS (SELECT doc_id, t.class, sum(tf * (ln(t.n + 1.0) - ln(1.0))) AS s
         FROM tf JOIN terms t USING (term) GROUP BY 1, 2),
dl AS (SELECT id AS doc_id, sum(coalesce(len(regexp_extract_all(lower(input_text), '[\\p{L}\\p{N}_]{2,}')), 0)) AS len
       FROM v_predictions GROUP BY 1),
sc AS (SELECT dl.doc_id, cls.class, log_prior + len * (ln(1.0) - ln(denom)) + coalesce(seen.s, 0.0) AS score
       FROM dl CROSS JOIN cls LEFT JOIN seen ON seen.doc_id = dl.doc_id AND seen.class = cls.class),
best AS (SELECT doc_id, class FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class) AS r FROM sc)
         WHERE r = 1)
SELECT class AS predicted_category, count(*) AS count FROM best GROUP BY 1"""

reg("ol_incremental_model", _nb_scores, NB_SCORE_SQL, ["v_feedback", "v_predictions"])


def _stats(s, sf):
    from ticketscope.operators.windows import win_ema
    p = spark_view(s, sf, "v_predictions").select("id", "ts", "model_name", "latency_ms", "predicted_class")
    e = win_ema(p, value="latency_ms", group="model_name", order=["ts", "id"], alpha=0.1)
    last = e.groupBy("model_name").agg(F.max_by("ema", F.struct("ts", "id")).alias("avg_processing_time_ms"),
                                       F.count("*").alias("total_processed"),
                                       F.count_if(F.col("predicted_class") == "Error").alias("total_errors"),
                                       ((epoch_micros(F.max("ts")) - epoch_micros(F.min("ts")))
                                        / F.lit(1e6)).alias("uptime_seconds"))
    return last.withColumn("throughput_per_second", F.col("total_processed") / F.col("uptime_seconds"))


reg("st_stats", _stats,
    """WITH RECURSIVE o AS (
         SELECT id, ts, model_name, latency_ms, predicted_class,
                row_number() OVER (PARTITION BY model_name ORDER BY ts, id) AS rn FROM v_predictions),
       e AS (SELECT model_name, rn, latency_ms AS ema FROM o WHERE rn = 1
             UNION ALL
             SELECT o.model_name, o.rn, 0.9 * e.ema + 0.1 * o.latency_ms
             FROM e JOIN o ON o.model_name = e.model_name AND o.rn = e.rn + 1),
       g AS (SELECT model_name, count(*) AS total_processed, count(*) FILTER (WHERE predicted_class = 'Error') AS total_errors,
                    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS uptime_seconds, max(rn) AS last_rn FROM o GROUP BY 1)
    SELECT g.model_name, e.ema AS avg_processing_time_ms, total_processed, total_errors, uptime_seconds,
           total_processed / uptime_seconds AS throughput_per_second
    FROM g JOIN e ON e.model_name = g.model_name AND e.rn = g.last_rn""", ["v_predictions"],
    ["avg_processing_time_ms", "uptime_seconds", "throughput_per_second"])


def _count_batches(s, sf):
    """Batches of ten per event type; what is left over stays in the state."""
    from ticketscope.streaming.stateful import st_count_or_timeout
    base = _fresh(s, "count-batches")
    src = _events_stream(s, sf).select("event_id", "event_type", "ts")
    out = st_count_or_timeout(src, key="event_type", size=10, timeout_seconds=None, order=["event_id"])
    q = (out.writeStream.format("parquet").option("path", os.path.join(base, "out")).outputMode("append")
         .option("checkpointLocation", os.path.join(base, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    r = s.read.schema("key string, batch_no long, fired string, n int, rows array<string>").parquet(os.path.join(base, "out"))
    ids = F.transform("rows", lambda x: F.get_json_object(x, "$.event_id").cast("long"))
    return r.groupBy("key").agg(F.count("*").alias("batches"), F.sum("n").alias("n_rows"), F.max("batch_no").alias("last_batch"),
                                F.count_if(F.col("fired") == "count").alias("by_count"),
                                F.size(F.array_distinct(F.flatten(F.collect_list(ids)))).alias("n_distinct"))


reg("st_count_or_timeout", _count_batches,
    """SELECT event_type AS key, count(*) // 10 AS batches, CAST(count(*) // 10 * 10 AS BIGINT) AS n_rows, count(*) // 10 - 1 AS last_batch,
              count(*) // 10 AS by_count, CAST(count(*) // 10 * 10 AS INTEGER) AS n_distinct
       FROM events WHERE event_type IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")


def _running_stats(s, sf):
    from ticketscope.streaming.stateful import st_running_stats
    base = _fresh(s, "running-stats")
    p = spark_view(s, sf, "v_predictions").select("id", F.col("ts").cast("timestamp").alias("ts"), "model_name", "latency_ms",
                                                  (F.col("predicted_class") == "Error").alias("is_error"))
    out = st_running_stats(_in_time_order(s, p, "stats-in"), key="model_name", value="latency_ms", order=["id"])

    def write(batch, batch_id):  # one folder per micro-batch: a replay writes it again
        batch.write.mode("overwrite").parquet(os.path.join(base, "out", f"batch_id={batch_id}"))

    q = (out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    r = s.read.parquet(os.path.join(base, "out"))
    last = r.groupBy("key").agg(F.max_by(F.struct(*[c for c in r.columns if c not in ("key", "batch_id")]), "batch_id").alias("r"))
    return last.select(F.col("key").alias("model_name"), "r.*")


reg("st_running_stats", _running_stats, [q.sql for q in Q if q.name == "st_stats"][0], ["v_predictions"],
    ["avg_processing_time_ms", "uptime_seconds", "throughput_per_second"])


#: Feedback rows of a micro-batch.
FEEDBACK_ROWS = 200_000


def _feedback_buffer(s, sf):
    """Feedback per model as a stream in time order; every update with the counts
    that its refit holds."""
    from ticketscope.streaming.stateful import nb_refits, st_feedback_buffer
    base = _fresh(s, "feedback-buffer")
    f = spark_view(s, sf, "v_feedback").select("id", "ts", "text", "true_category",
                                               F.concat(F.lit("m"), F.col("user_id").cast("long") % 3).alias("model_name"))
    files = max(4, -(-f.count() // FEEDBACK_ROWS))  # a task holds a micro-batch's rows of a key
    out = st_feedback_buffer(_in_time_order(s, f, "feedback-in", files), key="model_name", order=["ts", "id"])
    q = (out.writeStream.format("parquet").option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    updates = s.read.parquet(os.path.join(base, "out"))
    return nb_refits(updates, "text string, true_category string").withColumnRenamed("key", "model_name")


reg("ol_feedback_buffer", _feedback_buffer,
    """WITH f AS (SELECT *, 'm' || CAST(CAST(user_id AS BIGINT) % 3 AS VARCHAR) AS model_name FROM v_feedback),
    o AS (SELECT model_name, text, true_category, row_number() OVER (PARTITION BY model_name ORDER BY ts, id) AS rn FROM f),
    u AS (SELECT model_name, rn AS due, CAST((rn - 50) // 10 AS BIGINT) AS update_no FROM o WHERE rn >= 50 AND (rn - 50) % 10 = 0),
    r AS (SELECT u.model_name, u.update_no, o.true_category AS class, o.text FROM u JOIN o
          ON o.model_name = u.model_name AND o.rn > u.due - 50 AND o.rn <= u.due)
    SELECT model_name, update_no, class, term, count(*) AS n FROM (
      SELECT model_name, update_no, class, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM r
      UNION ALL SELECT model_name, update_no, class, '' FROM r) GROUP BY 1, 2, 3, 4""", ["v_feedback"])


def _classify_model(s, sf):
    """The stream through a fitted pipeline: tickets as a file stream, each
    micro-batch scored by the model that the batch path uses."""
    from ticketscope.operators import ml as ML
    base = _fresh(s, "classify-model")
    t = spark_view(s, sf, "v_tickets").select("ticket_id", "customer_message", "category", "ts")
    model = ML.ml_train_pipeline(t, model_type="logistic_regression")

    def scorer(df):
        return ML.ml_predict_batch(model, df, with_prob_columns=False).withColumn("processing_time_ms", F.lit(0.0)).select(
            "ticket_id", "ts", "predicted_category", "confidence", "processing_time_ms")

    q = P.run_classification_stream(s, _in_time_order(s, t, "tickets-in"), scorer, out_path=base,
                                    checkpoint=os.path.join(base, "_checkpoint"), order=["ts", "ticket_id"])
    q.awaitTermination()
    return s.read.parquet(os.path.join(base, "results")).select("ticket_id", "predicted_category", "confidence", "escalation_required")


reg("st_classify_model", _classify_model)


def _messages(df):
    """Message text per event: every 11th invalid JSON, every 7th without the
    required field, even ids carry a ticket id, every 3rd a priority."""
    eid = F.col("event_id").cast("string")
    tid = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"ticket_id": "t'), eid, F.lit('", '))).otherwise(F.lit(""))
    pri = F.when(F.col("event_id") % 3 == 0, F.lit(', "priority": "high"')).otherwise(F.lit(""))
    good = F.concat(F.lit("{"), tid, F.lit('"customer_message": "'), F.col("event_type"), F.lit('"'), pri, F.lit("}"))
    nomsg = F.concat(F.lit('{"ticket_id": "t'), eid, F.lit('"}'))
    msg = (F.when(F.col("event_id") % 11 == 0, F.lit('{"customer_message": '))
           .when(F.col("event_id") % 7 == 0, nomsg).otherwise(good))
    return df.select(F.col("event_id").alias("msg_offset"), msg.alias("value"))


def _decode(s, sf):
    m = _messages(s.read.parquet(f"{sf}/events.parquet"))
    d = P.decode_messages(m, value_col="value", offset_col="msg_offset", channel="websocket", id_prefix="ws_")
    return d.select("msg_offset", "ticket_id", "customer_message", "priority", "channel", "error")


DECODE_SQL = """WITH m AS (SELECT event_id AS msg_offset,
    CASE WHEN event_id % 11 = 0 THEN '{"customer_message": '
         WHEN event_id % 7 = 0 THEN '{"ticket_id": "t' || CAST(event_id AS VARCHAR) || '"}'
         ELSE '{' || CASE WHEN event_id % 2 = 0 THEN '"ticket_id": "t' || CAST(event_id AS VARCHAR) || '", ' ELSE '' END
              || '"customer_message": "' || event_type || '"'
              || CASE WHEN event_id % 3 = 0 THEN ', "priority": "high"' ELSE '' END || '}' END AS value
  FROM events),
v AS (SELECT msg_offset, value, json_valid(value) AS ok FROM m)
SELECT msg_offset,
  coalesce(CASE WHEN ok THEN json_extract_string(value, '$.ticket_id') END, 'ws_' || CAST(msg_offset AS VARCHAR)) AS ticket_id,
  CASE WHEN ok THEN json_extract_string(value, '$.customer_message') END AS customer_message,
  coalesce(CASE WHEN ok THEN json_extract_string(value, '$.priority') END, 'medium') AS priority,
  'websocket' AS channel,
  CASE WHEN NOT ok THEN 'Invalid JSON format'
       WHEN json_extract_string(value, '$.customer_message') IS NULL THEN 'Missing required field: ''customer_message''' END AS error
FROM v"""
reg("src_ws_messages", _decode, DECODE_SQL)


def _kafka_roundtrip(s, sf):
    m = _messages(s.read.parquet(f"{sf}/events.parquet"))
    d = P.decode_messages(m, value_col="value", offset_col="msg_offset")
    ok = d.where(F.col("error").isNull()).select("ticket_id", "customer_message", "priority", "channel")
    enc = P.encode_results(ok)
    back = enc.select(F.from_json("value", "ticket_id string, customer_message string, priority string, channel string").alias("r"))
    return back.select("r.*")


reg("src_kafka", _kafka_roundtrip,
    "SELECT replace(ticket_id, 'ws_', 'kafka_') AS ticket_id, customer_message, priority, 'kafka' AS channel FROM ("
    + DECODE_SQL + ") WHERE error IS NULL")
def _kafka_sink_roundtrip(s, sf):
    enc = P.encode_results(_fixture_scorer(s.read.parquet(f"{sf}/events.parquet")))
    back = F.from_json("value", "ticket_id long, predicted_category string, confidence double")
    return enc.select("key", back.alias("r")).select("key", "r.*")


reg("snk_kafka", _kafka_sink_roundtrip,
    "SELECT CAST(id AS VARCHAR) AS key, id AS ticket_id, predicted_class AS predicted_category, confidence "
    "FROM v_predictions", ["v_predictions"], ["confidence"])


def _in_time_order(s, df, name: str, files: int = 4):
    """``df`` staged as ``files`` files of ascending ``ts``, read one per micro-batch."""
    stage = _fresh(s, name)
    edges = df.agg(F.array(*[F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), (i + 1) / files, 10000)
                             for i in range(files - 1)]).alias("e")).first().e
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    parts = _fresh(s, f"{name}-parts")
    edge = F.array(*[F.lit(e) for e in edges or []])
    dealt = df.where(at.isNotNull()).withColumn("_part", F.size(F.filter(edge, lambda e: e < at)))
    dealt.repartition(files, "_part").write.partitionBy("_part").parquet(parts)  # the input is read once, not once per file
    there = [r["_part"] for r in s.read.parquet(parts).select("_part").distinct().orderBy("_part").collect()]
    for i in there:  # one write after another: the file source reads by modification time
        s.read.schema(df.schema).parquet(f"{parts}/_part={i}").coalesce(1).write.mode("append").parquet(stage)
    if not there:
        df.limit(0).coalesce(1).write.parquet(stage)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(stage)


def _dedupe(s, sf):
    """Every seventh ticket comes twice, the second time up to 30 minutes later."""
    base = _fresh(s, "dedupe")
    e = s.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("ticket_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    again = e.where("ticket_id % 7 = 0").withColumn(
        "ts", F.timestamp_add("MINUTE", (F.col("ticket_id") % 30).cast("int"), F.col("ts")))
    src = _in_time_order(s, e.unionByName(again), "dedupe-in")
    out = P.st_dedupe_late(src, key=["ticket_id"], watermark="1 hour").drop("ts")
    q = (out.writeStream.format("parquet").option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    return s.read.parquet(os.path.join(base, "out"))


reg("st_dedupe_late", _dedupe, "SELECT event_id AS ticket_id, user_id, event_type FROM events")


def _windowed_stream(s, sf):
    base = _fresh(s, "windowed")
    p = spark_view(s, sf, "v_predictions")
    # a last row two days on moves the watermark past every window: all of them are emitted
    end = (p.orderBy(F.desc("ts")).limit(1).withColumn("model_name", F.lit("(end)"))
           .withColumn("ts", F.timestamp_add("DAY", F.lit(2), F.col("ts"))))
    src = _in_time_order(s, p.unionByName(end), "windowed-in")
    out = P.st_windowed_metrics(src, window="1 hour", slide="10 minutes", watermark="1 hour")
    q = (out.writeStream.format("parquet").option("path", os.path.join(base, "out")).outputMode("append")
         .option("checkpointLocation", os.path.join(base, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    return s.read.parquet(os.path.join(base, "out")).where("model_name <> '(end)'").select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "model_name", "n", "accuracy", "avg_confidence",
        "avg_latency_ms", "error_rate")


reg("st_windowed_metrics_stream", _windowed_stream,
    """SELECT time_bucket(INTERVAL 10 MINUTES, ts) - k * INTERVAL 10 MINUTES AS window_start, model_name, count(*) AS n,
              avg(CAST(is_correct AS INTEGER)) AS accuracy, avg(confidence) AS avg_confidence,
              avg(latency_ms) AS avg_latency_ms, avg(CAST(predicted_class = 'Error' AS INTEGER)) AS error_rate
       FROM v_predictions, range(6) t(k) GROUP BY 1, 2""",
    ["v_predictions"], ["accuracy", "avg_confidence", "avg_latency_ms", "error_rate"])


def _score_hook(s, sf):
    import pandas as pd

    def external(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"predicted_category": ["General Inquiry"] * len(texts),
                             "confidence": texts.str.len().clip(upper=100) / 100.0})

    hook = P.udf_score_hook(external)
    t = spark_view(s, sf, "v_tickets")
    return t.select("ticket_id", hook(F.col("customer_message")).alias("r")).select("ticket_id", "r.*")


reg("udf_score_hook", _score_hook,
    "SELECT ticket_id, 'General Inquiry' AS predicted_category, least(length(customer_message), 100) / 100.0 AS confidence "
    "FROM v_tickets", ["v_tickets"], ["confidence"])

QUERIES = Q
