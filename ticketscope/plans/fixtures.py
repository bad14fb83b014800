"""Deterministic fixture views over the driver's test tables.

Each view is defined twice, side by side: once as a Spark DataFrame
(``spark_view(spark, sf_dir, name)``) and once as DuckDB SQL
(``SQL_VIEWS[name]``) so the oracle can recompute it. Views only derive
columns from the given tables, so every query's work grows with them.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.constants import CATEGORIES, PRIORITY_LEVELS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Fixed values used by the fixture views (see FIXTURES.md).
RESPONSE_CATEGORIES = ["Billing", "Technical", "Complaint", "Compliment",
                       "Product Information"]
URGENCIES = ["low", "medium", "high"]
VOTE_CLASSES = CATEGORIES[:5]
DRIFT_SPLIT = "2024-01-16 00:00:00"
AB_START = "2024-01-05 00:00:00"
AB_END = "2024-01-25 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pick(values, idx: Column) -> Column:
    """0-based pick from a fixed list."""
    return F.element_at(_arr(values), (idx + 1).cast("int"))


def _ts(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


# ---------------------------------------------------------------- Spark side

def v_tickets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ticket_id"),
        F.col("text").alias("customer_message"),
        F.col("lang").alias("category"),
        _pick(PRIORITY_LEVELS, F.col("doc_id") % 4).alias("priority"),
        F.col("source").alias("channel"),
        F.timestamp_add("HOUR", F.col("doc_id") % 720, _ts("2024-01-01 00:00:00")).alias("ts"),
    )


def v_tickets_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("ticket_id"),
        F.col("o_orderstatus").alias("category"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("ts"),
    )


def v_predictions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pred = F.when(F.col("event_type") == "error", F.lit("Error")).otherwise(F.col("event_type"))
    actual = (F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string"))
              .when(F.col("event_id") % 5 == 0, F.lit("view"))
              .otherwise(pred))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_name"),
        F.col("props").alias("input_text"),
        pred.alias("predicted_class"),
        (_k().cast("double") / F.lit(100.0)).alias("confidence"),
        actual.alias("actual_class"),
        (actual == pred).alias("is_correct"),
        F.col("value").alias("latency_ms"),
        F.col("user_id"),
    )


def v_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    et = (F.when(F.col("event_type").isin("click", "error"), F.lit("prediction"))
          .when(F.col("event_type") == "view", F.lit("access"))
          .when(F.col("event_type") == "purchase", F.lit("training"))
          .otherwise(F.lit("model_update")))
    return e.select(
        F.col("event_id"),
        F.col("ts"),
        et.alias("event_type"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        F.sha2(F.col("props"), 256).alias("input_data_hash"),
        (_k().cast("double") / F.lit(100.0)).alias("confidence"),
    )


def v_rules(spark, sf_dir=None):
    """The three default compliance rules; retention shortened to 15 days."""
    return spark.createDataFrame(
        [("data_retention", "Data Retention Policy", "retention", "high", True, 15, None),
         ("bias_monitoring", "Model Bias Monitoring", "bias", "high", True, None, 0.5),
         ("access_logging", "Access Logging", "access", "medium", True, None, None)],
        "rule_id string, name string, rule_type string, severity string, enabled boolean, "
        "retention_days int, confidence_floor double")


def v_gdpr(spark, sf_dir):
    """One GDPR request of every user present in events."""
    e = table(spark, sf_dir, "events")
    u = e.select("user_id").where("user_id is not null").distinct()
    return u.select(
        F.concat(F.lit("req_"), F.col("user_id").cast("string")).alias("request_id"),
        _pick(["access", "deletion", "portability"], F.col("user_id") % 3).alias("request_type"),
        F.col("user_id").cast("string").alias("user_id"),
        # odd ids carry an e-mail identity that is another user's id, so the
        # OR branch of the identity match is exercised
        F.when(F.col("user_id") % 2 == 0, F.lit(None).cast("string"))
        .otherwise((F.col("user_id") + 10).cast("string")).alias("email"),
        F.lit("pending").alias("status"),
    )


def v_feedback(spark, sf_dir):
    p = v_predictions(spark, sf_dir)
    return p.where(F.col("actual_class").isNotNull()).select(
        F.col("id"), F.col("ts"), F.col("input_text").alias("text"),
        F.col("predicted_class").alias("predicted_category"),
        F.col("actual_class").alias("true_category"),
        F.col("confidence"), F.col("user_id").cast("string").alias("user_id"),
    )


def v_votes(spark, sf_dir):
    """Long vote table: one row per (text, model)."""
    e = table(spark, sf_dir, "events")
    m = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m")
    base = e.select(F.col("event_id"), _k().alias("k"), m)
    return base.select(
        F.col("event_id").alias("text_id"),
        F.concat(F.lit("model_"), F.col("m").cast("string")).alias("model"),
        _pick(VOTE_CLASSES, (F.col("event_id") * (F.col("m") + 1) + F.col("k")) % 5).alias("prediction"),
        (((F.col("k") + 17 * F.col("m")) % 100 + 1).cast("double") / F.lit(101.0)).alias("confidence"),
    )


def v_drift(spark, sf_dir, side: str, shifted: bool = False):
    e = table(spark, sf_dir, "events")
    cond = F.col("ts") < _ts(DRIFT_SPLIT) if side == "ref" else F.col("ts") >= _ts(DRIFT_SPLIT)
    value = F.col("value") * 1.5 if shifted else F.col("value")
    return e.where(cond).select(
        F.col("event_id").alias("id"), value.alias("value"),
        _k().cast("double").alias("k"), F.col("event_type").alias("label"),
        F.col("props").alias("text"))


def v_ab_log(spark, sf_dir):
    p = v_predictions(spark, sf_dir)
    return p.where(F.col("model_name").isin("m0", "m1")).select(
        F.col("id"), F.col("model_name").alias("version_id"), F.col("ts"),
        F.create_map(F.lit("confidence"), F.col("confidence"),
                     F.lit("latency_ms"), F.col("latency_ms")).alias("metrics"))


def v_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("request_id"), F.col("ts"))


def v_registry(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    version = F.concat_ws(".", F.lit("1"), F.col("p_size").cast("string"),
                          (F.col("p_partkey") % 10).cast("string"))
    created = F.timestamp_add("MINUTE", F.col("p_partkey"), _ts("2024-01-01 00:00:00"))
    return p.select(
        F.col("p_brand").alias("model_name"),
        version.alias("version"),
        created.alias("creation_date"),
        F.create_map(F.lit("accuracy"), F.col("p_retailprice") / F.lit(3000.0)).alias("performance_metrics"),
        F.col("p_partkey").alias("part_key"),
    )


def v_trials(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("trial"),
        F.col("p_type").alias("model_type"),
        F.col("p_retailprice").alias("obj1"),
        F.col("p_size").cast("double").alias("obj2"),
        (-(F.col("p_partkey") % 97)).cast("double").alias("obj3"),
    )


def v_response_req(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("props").alias("text"),
        _pick(RESPONSE_CATEGORIES, F.col("event_id") % 5).alias("category"),
        _pick(URGENCIES, F.col("event_id") % 3).alias("urgency"),
        (_k().cast("double") / F.lit(100.0)).alias("confidence"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("customer_name"),
        (F.col("user_id") % 5).alias("previous_complaints"),
        F.col("ts"),
    )


def v_modal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = _k()
    return e.select(
        F.col("event_id").alias("input_id"),
        F.col("event_type").alias("text"),
        F.lit(1.0).alias("text_conf"),
        F.when(F.col("event_id") % 2 == 0, k.cast("double") / F.lit(100.0)).alias("image_conf"),
        F.when(F.col("event_id") % 3 == 0, F.lit(0.3)).alias("audio_conf"),
        F.when(F.col("event_id") % 5 == 0, F.lit(0.9)).alias("document_conf"),
    )


SPARK_VIEWS = {
    "v_tickets": v_tickets,
    "v_tickets_orders": v_tickets_orders,
    "v_predictions": v_predictions,
    "v_audit": v_audit,
    "v_rules": v_rules,
    "v_gdpr": v_gdpr,
    "v_feedback": v_feedback,
    "v_votes": v_votes,
    "v_drift_ref": partial(v_drift, side="ref"),
    "v_drift_cur": partial(v_drift, side="cur"),
    "v_drift_cur_shift": partial(v_drift, side="cur", shifted=True),
    "v_ab_log": v_ab_log,
    "v_requests": v_requests,
    "v_registry": v_registry,
    "v_trials": v_trials,
    "v_response_req": v_response_req,
    "v_modal": v_modal,
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SPARK_VIEWS[name](spark, sf_dir)


# --------------------------------------------------------------- DuckDB side

_K = "CAST(json_extract(props, '$.k') AS INTEGER)"
_PRED = "CASE WHEN event_type = 'error' THEN 'Error' ELSE event_type END"
_ACTUAL = (f"CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'view' "
           f"ELSE {_PRED} END")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL_VIEWS: dict[str, str] = {
    "v_tickets": f"""
        SELECT doc_id AS ticket_id, text AS customer_message, lang AS category,
               {_sql_list(PRIORITY_LEVELS)}[doc_id % 4 + 1] AS priority, source AS channel,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS BIGINT)) AS ts
        FROM documents""",
    "v_tickets_orders": """
        SELECT o_orderkey AS ticket_id, o_orderstatus AS category,
               o_orderpriority AS priority, o_orderdate AS ts
        FROM orders""",
    "v_predictions": f"""
        SELECT event_id AS id, ts, 'm' || CAST(user_id % 3 AS VARCHAR) AS model_name,
               props AS input_text, {_PRED} AS predicted_class,
               CAST({_K} AS DOUBLE) / 100.0 AS confidence,
               {_ACTUAL} AS actual_class, ({_ACTUAL}) = ({_PRED}) AS is_correct,
               value AS latency_ms, user_id
        FROM events""",
    "v_audit": f"""
        SELECT event_id, ts,
               CASE WHEN event_type IN ('click', 'error') THEN 'prediction'
                    WHEN event_type = 'view' THEN 'access'
                    WHEN event_type = 'purchase' THEN 'training'
                    ELSE 'model_update' END AS event_type,
               CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id,
               'm' || CAST(user_id % 3 AS VARCHAR) AS model_id,
               sha256(props) AS input_data_hash,
               CAST({_K} AS DOUBLE) / 100.0 AS confidence
        FROM events""",
    "v_rules": """
        SELECT * FROM (VALUES
          ('data_retention', 'Data Retention Policy', 'retention', 'high', true, 15, NULL),
          ('bias_monitoring', 'Model Bias Monitoring', 'bias', 'high', true, NULL, 0.5),
          ('access_logging', 'Access Logging', 'access', 'medium', true, NULL, NULL))
          AS t(rule_id, name, rule_type, severity, enabled, retention_days, confidence_floor)""",
    "v_gdpr": """
        SELECT 'req_' || CAST(user_id AS VARCHAR) AS request_id,
               ['access', 'deletion', 'portability'][user_id % 3 + 1] AS request_type,
               CAST(user_id AS VARCHAR) AS user_id,
               CASE WHEN user_id % 2 = 0 THEN NULL ELSE CAST(user_id + 10 AS VARCHAR) END AS email,
               'pending' AS status
        FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)""",
    "v_feedback": """
        SELECT id, ts, input_text AS text, predicted_class AS predicted_category,
               actual_class AS true_category, confidence, CAST(user_id AS VARCHAR) AS user_id
        FROM v_predictions WHERE actual_class IS NOT NULL""",
    "v_votes": f"""
        SELECT event_id AS text_id, 'model_' || CAST(m AS VARCHAR) AS model,
               {_sql_list(VOTE_CLASSES)}[(event_id * (m + 1) + k) % 5 + 1] AS prediction,
               CAST((k + 17 * m) % 100 + 1 AS DOUBLE) / 101.0 AS confidence
        FROM (SELECT event_id, {_K} AS k FROM events) e,
             (SELECT unnest([0, 1, 2]) AS m) mm""",
    "v_drift_ref": f"""
        SELECT event_id AS id, value, CAST({_K} AS DOUBLE) AS k, event_type AS label, props AS text
        FROM events WHERE ts < TIMESTAMP '{DRIFT_SPLIT}'""",
    "v_drift_cur": f"""
        SELECT event_id AS id, value, CAST({_K} AS DOUBLE) AS k, event_type AS label, props AS text
        FROM events WHERE ts >= TIMESTAMP '{DRIFT_SPLIT}'""",
    "v_drift_cur_shift": f"""
        SELECT event_id AS id, value * 1.5 AS value, CAST({_K} AS DOUBLE) AS k,
               event_type AS label, props AS text
        FROM events WHERE ts >= TIMESTAMP '{DRIFT_SPLIT}'""",
    "v_ab_log": """
        SELECT id, model_name AS version_id, ts, confidence, latency_ms
        FROM v_predictions WHERE model_name IN ('m0', 'm1')""",
    "v_requests": """
        SELECT CAST(event_id AS VARCHAR) AS request_id, ts FROM events""",
    "v_registry": """
        SELECT p_brand AS model_name,
               '1.' || CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) AS version,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey) AS creation_date,
               p_retailprice / 3000.0 AS accuracy, p_partkey AS part_key
        FROM part""",
    "v_trials": """
        SELECT p_partkey AS trial, p_type AS model_type, p_retailprice AS obj1,
               CAST(p_size AS DOUBLE) AS obj2, CAST(-(p_partkey % 97) AS DOUBLE) AS obj3
        FROM part""",
    "v_response_req": f"""
        SELECT event_id AS request_id, props AS text,
               {_sql_list(RESPONSE_CATEGORIES)}[event_id % 5 + 1] AS category,
               {_sql_list(URGENCIES)}[event_id % 3 + 1] AS urgency,
               CAST({_K} AS DOUBLE) / 100.0 AS confidence,
               'User ' || CAST(user_id AS VARCHAR) AS customer_name,
               user_id % 5 AS previous_complaints, ts
        FROM events""",
    "v_modal": f"""
        SELECT event_id AS input_id, event_type AS text, 1.0 AS text_conf,
               CASE WHEN event_id % 2 = 0 THEN CAST({_K} AS DOUBLE) / 100.0 END AS image_conf,
               CASE WHEN event_id % 3 = 0 THEN 0.3 END AS audio_conf,
               CASE WHEN event_id % 5 = 0 THEN 0.9 END AS document_conf
        FROM events""",
}

# views that read other views (order matters in the WITH list)
_DEPS = {"v_feedback": ["v_predictions"], "v_ab_log": ["v_predictions"]}


def with_views(views: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs for ``views`` (and their dependencies)."""
    ordered: list[str] = []
    for v in views:
        for d in _DEPS.get(v, []) + [v]:
            if d not in ordered:
                ordered.append(d)
    ctes = ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in ordered)
    body = body.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
