"""Sources and sinks as round trips: write the given tables (or views derived
from them) to the shared scratch folder, read them back through the source
operators, compare with DuckDB."""

from __future__ import annotations

import os
import uuid
from itertools import groupby
from urllib.parse import urlparse

from pyspark.sql import functions as F

from ticketscope.operators.aggs import agg_feature_ref_stats
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query
from ticketscope.sources import files as SF
from ticketscope.sources import sinks as SK
from ticketscope.streaming.jobs import scratch

Q = []


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def _fresh(s, name):
    return scratch(s, f"io-{name}-{uuid.uuid4().hex}")


def _log(s, sf):
    base = _fresh(s, "log")
    p = spark_view(s, sf, "v_predictions").drop("is_correct")
    SK.snk_append_log(p, base)
    return s, base


def _log_scan(s, sf):
    s, base = _log(s, sf)
    d = SK.src_prediction_log_scan(s, base, model_name="m1", start="2024-01-10 00:00:00", end="2024-01-12 12:00:00")
    return d.select("id", "ts", "predicted_class", "is_correct")


reg("src_prediction_log_scan", _log_scan,
    """SELECT id, ts, predicted_class, is_correct FROM v_predictions
       WHERE model_name = 'm1' AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""",
    ["v_predictions"])


def _append_log(s, sf):
    s, base = _log(s, sf)
    return s.read.parquet(base).groupBy("date").agg(F.count("*").alias("n"), F.count("is_correct").alias("labeled"))


reg("snk_append_log", _append_log,
    "SELECT CAST(ts AS DATE) AS date, count(*) AS n, count(is_correct) AS labeled FROM v_predictions GROUP BY 1",
    ["v_predictions"])


def _csv(s, sf):
    base = _fresh(s, "csv")
    t = spark_view(s, sf, "v_tickets").withColumnRenamed("ts", "timestamp")
    t = t.withColumn("category", F.when(F.col("ticket_id") % 9 == 0, F.lit(None)).otherwise(F.col("category")))
    t.write.option("header", True).option("escape", '"').csv(base)
    d = SF.src_csv_tickets(s, base)
    return d.select(F.col("ticket_id").cast("long").alias("ticket_id"), "category",
                    F.length("customer_message").alias("message_length"))


reg("src_csv_tickets", _csv,
    """SELECT ticket_id, category, length(customer_message) AS message_length FROM v_tickets
       WHERE ticket_id % 9 <> 0 AND customer_message IS NOT NULL""", ["v_tickets"])


def _formats(s, sf):
    base = _fresh(s, "json")
    spark_view(s, sf, "v_tickets").withColumnRenamed("ts", "timestamp").write.json(base)
    d = SF.src_csv_tickets(s, base, fmt="json")
    return d.groupBy("category").agg(F.count("*").alias("n"))


reg("src_formats", _formats, "SELECT category, count(*) AS n FROM v_tickets GROUP BY 1", ["v_tickets"])


def _union_status(s, sf):
    a = spark_view(s, sf, "v_tickets").select("ticket_id", "category", "ts")
    b = spark_view(s, sf, "v_tickets_orders")
    return SF.src_union_status(SF.src_union_sources([("documents", a), ("orders", b)]))


reg("src_union_sources", _union_status,
    """SELECT 'documents' AS data_source, count(*) AS rows, 'loaded' AS status FROM v_tickets
       UNION ALL SELECT 'orders', count(*), 'loaded' FROM v_tickets_orders""", ["v_tickets", "v_tickets_orders"])

reg("src_validate_schema", lambda s, sf: SF.src_validate_schema(spark_view(s, sf, "v_tickets")),
    """SELECT CASE WHEN count(customer_message) = 0 OR count(category) = 0 THEN false ELSE true END AS is_valid,
              CASE WHEN count(customer_message) = 0 THEN 'Column ''customer_message'' is completely empty'
                   WHEN count(category) = 0 THEN 'Column ''category'' is completely empty' ELSE 'Format is valid' END
                AS message FROM v_tickets""", ["v_tickets"])


def _write_attachments(d, base):
    """A folder with one text file per document; where it is to be read. On a file system that tasks can open,
    they write the files themselves: Spark's writer starts processes for the
    permissions of every local file and folder."""
    at = urlparse(base)
    if at.scheme not in ("", "file"):
        d.write.partitionBy("doc_id").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(base)
        return base
    os.makedirs(at.path, exist_ok=True)

    def write(rows):
        for doc_id, same in groupby(rows, lambda r: r.doc_id):
            folder = os.path.join(at.path, f"doc_id={doc_id}")
            os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, "part.txt"), "wb") as f:
                f.writelines(((r.text or "") + "\n").encode() for r in same)

    d.repartition("doc_id").sortWithinPartitions("doc_id").foreachPartition(write)
    return f"file://{at.path}"


def _attachments(s, sf):
    base = _fresh(s, "att")
    d = s.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    r = SF.src_text_attachments(s, _write_attachments(d, base),
                                ticket_of=F.regexp_extract("path", r"doc_id=([0-9]+)", 1).cast("long"))
    return r.select(F.col("ticket_id").alias("doc_id"), F.length("extracted_text").alias("n_chars"),
                    "processed_count", "confidence")


reg("src_text_attachments", _attachments,
    r"""SELECT doc_id, length(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS n_chars,
              1 AS processed_count, 1.0 AS confidence
       FROM documents WHERE length(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) > 0""",
    [], ["confidence"])


def _corrections(s, sf):
    base = _fresh(s, "corr")
    SK.snk_export_corrections(spark_view(s, sf, "v_feedback"), base, fmt="json")
    r = s.read.schema("text string, category string, original_prediction string, confidence double").json(base)
    return r.groupBy("category", "original_prediction").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))


reg("snk_export_corrections", _corrections,
    """SELECT true_category AS category, predicted_category AS original_prediction, count(*) AS n, avg(confidence) AS c
       FROM v_feedback GROUP BY 1, 2""", ["v_feedback"], ["c"])


def _export_audit(s, sf):
    base = _fresh(s, "audit")
    ev = spark_view(s, sf, "v_audit")
    t = ev.select(F.max("ts")).scalar()
    SK.export(ev.where(F.col("ts") > t - F.make_dt_interval(F.lit(30))), base + "/audit.csv", order=[F.desc("ts")])
    r = s.read.option("header", True).schema(ev.schema).csv(base + "/audit.csv")
    return r.groupBy("event_type").agg(F.count("*").alias("n"))


reg("snk_export_audit", _export_audit,
    """SELECT event_type, count(*) AS n FROM v_audit WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY
       GROUP BY 1""", ["v_audit"])


def _state(s, sf):
    base = _fresh(s, "state")
    SK.save_state(agg_feature_ref_stats(spark_view(s, sf, "v_drift_ref"), ["value", "k"]), base)
    return SK.load_state(s, base).select("feature", "mean", "std", "p50")


reg("state_reference_stats", _state,
    """SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS p50 FROM
       (SELECT 'value' AS feature, value FROM v_drift_ref UNION ALL SELECT 'k', k FROM v_drift_ref) GROUP BY 1""",
    ["v_drift_ref"], ["mean", "std", "p50"])


def _state_model(s, sf):
    from pyspark.ml import PipelineModel
    from ticketscope.operators import ml as ML
    base = _fresh(s, "model")
    t = spark_view(s, sf, "v_tickets")
    m = ML.ml_train_pipeline(t, model_type="logistic_regression", max_features=10000)
    m.write().overwrite().save(base)
    back = PipelineModel.load(base)
    return ML.ml_predict_batch(back, t, with_prob_columns=False).select("ticket_id", "predicted_category")


reg("state_model", _state_model)

QUERIES = Q
