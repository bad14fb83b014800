"""Sinks: append-only logs partitioned by date, exports, state tables.

Appends write with ``partitionBy("date")`` so later time-window scans prune
partitions; rewrites (erasure, retention) use dynamic partition overwrite
so only touched dates are rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_is_correct(df: DataFrame) -> DataFrame:
    """``is_correct = predicted == actual`` or null when unlabeled."""
    return df.withColumn("is_correct", F.when(F.col("actual_class").isNotNull(),
                                              F.col("predicted_class") == F.col("actual_class")))


def snk_append_log(df: DataFrame, path: str, *, ts: str = "ts") -> None:
    """Append predictions to a date-partitioned Parquet log."""
    with_is_correct(df).withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def src_prediction_log_scan(spark: SparkSession, path: str, *, model_name: str, start, end) -> DataFrame:
    """One model in a closed time range: partition pruning on ``date`` plus
    pushed predicates on model_name / ts."""
    log = spark.read.parquet(path)
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return log.where((F.col("date") >= F.to_date(s)) & (F.col("date") <= F.to_date(e))
                     & (F.col("model_name") == model_name) & F.col("ts").between(s, e))


def snk_append(df: DataFrame, path: str, *, partition_ts: str | None = "ts") -> None:
    """Generic append (audit events, feedback, performance logs, model history)."""
    w = df.withColumn("date", F.to_date(partition_ts)) if partition_ts else df
    writer = w.write.mode("append")
    (writer.partitionBy("date") if partition_ts else writer).parquet(path)


def overwrite_partitions(df: DataFrame, path: str) -> None:
    """Rewrite only the date partitions present in ``df`` (retention / erasure)."""
    df.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    df.write.mode("overwrite").partitionBy("date").parquet(path)


def export(df: DataFrame, path: str, *, fmt: str | None = None, order: list | None = None) -> None:
    """CSV (with header) or JSON lines, chosen by extension or ``fmt``; newest first."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json") else None)
    if fmt not in ("csv", "json"):
        raise ValueError("Unsupported file format. Use .csv or .json")
    d = df.orderBy(*order) if order else df
    if fmt == "csv":
        d.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        d.write.mode("overwrite").json(path)


def snk_export_metrics(metrics_long: DataFrame, path: str, *, as_of, hours: int = 24, model_name: str | None = None):
    d = metrics_long.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    if model_name:
        d = d.where(F.col("model_name") == model_name)
    export(d, path, order=[F.desc("ts")])


def snk_export_corrections(feedback: DataFrame, path: str, fmt: str = "csv") -> None:
    """Corrections projected for retraining: text, category (correct), original_prediction, confidence, timestamp."""
    d = feedback.select("text", F.col("true_category").alias("category"),
                        F.col("predicted_category").alias("original_prediction"), "confidence",
                        F.col("ts").alias("timestamp"))
    export(d, path, fmt=fmt)


def save_state(df: DataFrame, path: str) -> None:
    """State tables (reference stats, feedback, thresholds): overwrite Parquet."""
    df.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
