"""Declared schemas of the tables the operators read and write (never inferred)."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, MapType, StringType,
                               StructField, StructType, TimestampType)

TICKETS = StructType([
    StructField("ticket_id", StringType()),
    StructField("customer_message", StringType()),
    StructField("category", StringType()),
    StructField("timestamp", TimestampType()),
    StructField("priority", StringType()),
    StructField("channel", StringType()),
])

PREDICTIONS = StructType([
    StructField("id", LongType()),
    StructField("ts", TimestampType()),
    StructField("model_name", StringType()),
    StructField("input_text", StringType()),
    StructField("predicted_class", StringType()),
    StructField("confidence", DoubleType()),
    StructField("actual_class", StringType()),
    StructField("is_correct", BooleanType()),
    StructField("latency_ms", DoubleType()),
    StructField("metadata", MapType(StringType(), StringType())),
])

ALERTS = StructType([
    StructField("ts", TimestampType()),
    StructField("alert_type", StringType()),
    StructField("severity", StringType()),
    StructField("message", StringType()),
    StructField("model_name", StringType()),
    StructField("metric_name", StringType()),
    StructField("current_value", DoubleType()),
    StructField("threshold", DoubleType()),
    StructField("resolved", BooleanType()),
])

LINEAGE = StructType([
    StructField("source_type", StringType()),
    StructField("ts", TimestampType()),
    StructField("transformations", ArrayType(StringType())),
    StructField("data_hash", StringType()),
])

AUDIT_EVENTS = StructType([
    StructField("event_id", StringType()),
    StructField("ts", TimestampType()),
    StructField("event_type", StringType()),
    StructField("user_id", StringType()),
    StructField("model_id", StringType()),
    StructField("input_data_hash", StringType()),
    StructField("output_data", MapType(StringType(), StringType())),
    StructField("metadata", MapType(StringType(), StringType())),
    StructField("compliance_tags", ArrayType(StringType())),
    StructField("data_lineage", LINEAGE),
])

FEEDBACK = StructType([
    StructField("id", LongType()),
    StructField("ts", TimestampType()),
    StructField("text", StringType()),
    StructField("predicted_category", StringType()),
    StructField("true_category", StringType()),
    StructField("confidence", DoubleType()),
    StructField("user_id", StringType()),
    StructField("feedback_type", StringType()),
])

STREAM_MESSAGE = StructType([
    StructField("ticket_id", StringType()),
    StructField("customer_message", StringType()),
    StructField("priority", StringType()),
    StructField("customer_id", StringType()),
    StructField("metadata", MapType(StringType(), StringType())),
])
