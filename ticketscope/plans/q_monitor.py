"""Monitoring queries over v_predictions (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketscope.operators import monitor as M
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query

ASOF = "(SELECT max(ts) FROM events)"


def _preds(spark, sf):
    return spark_view(spark, sf, "v_predictions")


# ------------------------------------------------------------------ shared SQL

SNAPPED = ", ".join(f"round({c} * 1048576.0) / 1048576.0 AS {c}" for c in
                    ("cur_acc", "cur_conf", "cur_lat", "cur_err", "base_acc", "base_conf", "base_lat", "base_err"))


def _alerts_sql(pair: str, keep: str) -> str:
    """Four alert branches over a CTE ``pair`` with cur_*/base_* columns
    (averages snapped to the 2^-20 grid first, as in the Spark operator)."""
    pair = f"(SELECT * REPLACE ({SNAPPED}) FROM {pair})"
    def br(cond, typ, sev, metric, cur, thr, msg):
        return (f"SELECT {keep}, '{typ}' AS alert_type, {sev} AS severity, '{metric}' AS metric_name, "
                f"CAST({cur} AS DOUBLE) AS current_value, CAST({thr} AS DOUBLE) AS threshold, "
                f"{msg} AS message FROM {pair} WHERE cur_n > 0 AND base_n > 0 AND {cond}")
    lat = "(cur_lat / NULLIF(base_lat, 0))"
    parts = [
        br("base_acc - cur_acc > 0.05", "accuracy_degradation",
           "CASE WHEN base_acc - cur_acc > 0.1 THEN 'high' ELSE 'medium' END", "accuracy",
           "cur_acc", "base_acc - 0.05",
           "'Accuracy dropped by ' || printf('%.2f%%', round(round((base_acc - cur_acc) * 1048576.0) / 1048576.0 * 10000) / 100) || ' from baseline'"),
        br("base_conf - cur_conf > 0.1", "confidence_degradation", "'medium'", "avg_confidence",
           "cur_conf", "base_conf - 0.1",
           "'Average confidence dropped by ' || printf('%.2f%%', round(round((base_conf - cur_conf) * 1048576.0) / 1048576.0 * 10000) / 100) || ' from baseline'"),
        br(f"{lat} > 2.0", "latency_increase", f"CASE WHEN {lat} < 3 THEN 'low' ELSE 'medium' END",
           "avg_latency_ms", "cur_lat", "base_lat * 2.0",
           f"'Average latency increased by ' || printf('%.1f', round(round({lat} * 1048576.0) / 1048576.0 * 10) / 10) || 'x from baseline'"),
        br("cur_err - base_err > 0.02", "error_rate_increase", "'high'", "error_rate",
           "cur_err", "base_err + 0.02",
           "'Error rate increased by ' || printf('%.2f%%', round(round((cur_err - base_err) * 1048576.0) / 1048576.0 * 10000) / 100) || ' from baseline'"),
    ]
    return "\nUNION ALL\n".join(parts)


def _block_sql(cond: str, p: str) -> str:
    n = f"count(*) FILTER (WHERE {cond})"
    return (f"{n} AS {p}_n, avg(CAST(is_correct AS INTEGER)) FILTER (WHERE {cond}) AS {p}_acc, "
            f"avg(confidence) FILTER (WHERE {cond}) AS {p}_conf, "
            f"avg(latency_ms) FILTER (WHERE {cond}) AS {p}_lat, "
            f"CAST(count(*) FILTER (WHERE {cond} AND predicted_class = 'Error') AS DOUBLE) / NULLIF({n}, 0) AS {p}_err")


DEGRADATION_SQL = f"""
WITH t AS (SELECT max(ts) AS t FROM events),
p AS (SELECT v.*, t.t FROM v_predictions v, t WHERE ts >= t.t - INTERVAL 25 HOUR AND ts <= t.t),
pair AS (
  SELECT model_name, any_value(t) AS ts,
    {_block_sql("ts >= t - INTERVAL 1 HOUR AND ts <= t", "cur")},
    {_block_sql("ts >= t - INTERVAL 25 HOUR AND ts <= t - INTERVAL 1 HOUR", "base")}
  FROM p GROUP BY model_name)
{_alerts_sql("pair", "model_name, ts")}
"""

CHECKS_CTE = """
WITH bk AS (
  SELECT model_name, CAST(ceil(epoch_us(ts) / 600000000.0) AS BIGINT) AS b,
         count(*) AS n, count(is_correct) AS n_lab,
         CAST(sum(CAST(is_correct AS INTEGER)) AS BIGINT) AS n_ok,
         sum(confidence) AS s_conf, sum(latency_ms) AS s_lat,
         count(*) FILTER (WHERE predicted_class = 'Error') AS n_err
  FROM v_predictions GROUP BY ALL),
spine AS (SELECT DISTINCT model_name, unnest(range(b, b + 6)) AS b FROM bk),
bk2 AS (SELECT * FROM spine LEFT JOIN bk USING (model_name, b)),
pair AS (
  SELECT model_name, make_timestamp(b * 600 * 1000000) AS ts,
    sum(n) OVER cw AS cur_n,
    CAST(sum(n_ok) OVER cw AS DOUBLE) / NULLIF(sum(n_lab) OVER cw, 0) AS cur_acc,
    sum(s_conf) OVER cw / NULLIF(sum(n) OVER cw, 0) AS cur_conf,
    sum(s_lat) OVER cw / NULLIF(sum(n) OVER cw, 0) AS cur_lat,
    CAST(sum(n_err) OVER cw AS DOUBLE) / NULLIF(sum(n) OVER cw, 0) AS cur_err,
    sum(n) OVER bw AS base_n,
    CAST(sum(n_ok) OVER bw AS DOUBLE) / NULLIF(sum(n_lab) OVER bw, 0) AS base_acc,
    sum(s_conf) OVER bw / NULLIF(sum(n) OVER bw, 0) AS base_conf,
    sum(s_lat) OVER bw / NULLIF(sum(n) OVER bw, 0) AS base_lat,
    CAST(sum(n_err) OVER bw AS DOUBLE) / NULLIF(sum(n) OVER bw, 0) AS base_err
  FROM bk2
  WINDOW cw AS (PARTITION BY model_name ORDER BY b RANGE BETWEEN 5 PRECEDING AND CURRENT ROW),
         bw AS (PARTITION BY model_name ORDER BY b RANGE BETWEEN 149 PRECEDING AND 6 PRECEDING)),
checks AS (""" + _alerts_sql("pair", "model_name, ts") + ")"

CHECKS_SQL = CHECKS_CTE + "\nSELECT * FROM checks"

COOLDOWN_SQL = "WITH RECURSIVE " + CHECKS_CTE.strip()[5:] + """,
chain AS (
  SELECT alert_type, model_name, min(ts) AS ts FROM checks GROUP BY alert_type, model_name
  UNION ALL
  SELECT a.alert_type, a.model_name, min(a.ts)
  FROM chain c JOIN checks a
    ON a.alert_type = c.alert_type AND a.model_name = c.model_name
   AND a.ts >= c.ts + INTERVAL 60 MINUTE
  GROUP BY a.alert_type, a.model_name)
SELECT a.* FROM checks a SEMI JOIN chain c
  ON a.alert_type = c.alert_type AND a.model_name = c.model_name AND a.ts = c.ts
"""

METRICS_SQL = f"""
SELECT model_name,
  avg(CAST(is_correct AS INTEGER)) AS accuracy,
  count(is_correct) AS total_labeled_predictions,
  avg(confidence) AS avg_confidence, min(confidence) AS min_confidence,
  max(confidence) AS max_confidence, stddev_samp(confidence) AS confidence_std,
  avg(latency_ms) AS avg_latency_ms,
  quantile_cont(latency_ms, 0.95) AS p95_latency_ms,
  quantile_cont(latency_ms, 0.99) AS p99_latency_ms,
  count(*) AS total_predictions,
  CAST(count(*) AS DOUBLE) / 24.0 AS predictions_per_hour,
  CAST(count(*) FILTER (WHERE predicted_class = 'Error') AS DOUBLE) / count(*) AS error_rate
FROM v_predictions
WHERE ts >= {ASOF} - INTERVAL 24 HOUR AND ts <= {ASOF}
GROUP BY model_name
"""

METRIC_DBL = ("accuracy", "avg_confidence", "min_confidence", "max_confidence", "confidence_std",
              "avg_latency_ms", "p95_latency_ms", "p99_latency_ms", "predictions_per_hour",
              "error_rate")

REC_SQL = """concat_ws(' | ',
  CASE WHEN accuracy IS NOT NULL AND accuracy < 0.8 THEN 'Consider retraining the model with additional data' END,
  CASE WHEN accuracy IS NOT NULL AND accuracy < 0.9 AND coalesce(total_labeled_predictions, 0) < 100 THEN 'Collect more labeled data for better accuracy assessment' END,
  CASE WHEN coalesce(avg_confidence, 0) < 0.7 THEN 'Low average confidence detected - consider model calibration' END,
  CASE WHEN coalesce(confidence_std, 0) > 0.3 THEN 'High confidence variance - investigate prediction consistency' END,
  CASE WHEN coalesce(avg_latency_ms, 0) > 1000 THEN 'High latency detected - optimize model inference' END,
  CASE WHEN coalesce(p99_latency_ms, 0) > 5000 THEN 'Very high P99 latency - investigate performance bottlenecks' END,
  CASE WHEN coalesce(error_rate, 0) > 0.05 THEN 'High error rate - investigate input validation and error handling' END,
  CASE WHEN n_acc_alerts > 0 THEN 'Accuracy degradation detected - investigate concept drift' END,
  CASE WHEN n_lat_alerts > 0 THEN 'Latency increase detected - check system resources and model complexity' END,
  CASE WHEN coalesce(predictions_per_hour, 0) > 1000 THEN 'High prediction volume - consider caching and load balancing' END)"""

REPORT_SQL = CHECKS_CTE + f""",
m AS ({METRICS_SQL}),
a AS (SELECT model_name, count(*) AS n_alerts,
        count(*) FILTER (WHERE severity IN ('high', 'critical')) AS n_high,
        count(*) FILTER (WHERE alert_type = 'accuracy_degradation') AS n_acc_alerts,
        count(*) FILTER (WHERE alert_type = 'latency_increase') AS n_lat_alerts
      FROM checks WHERE ts >= {ASOF} - INTERVAL 24 HOUR GROUP BY model_name),
j AS (SELECT m.*, coalesce(a.n_alerts, 0) AS n_alerts, coalesce(a.n_high, 0) AS n_high,
        coalesce(a.n_acc_alerts, 0) AS n_acc_alerts, coalesce(a.n_lat_alerts, 0) AS n_lat_alerts
      FROM m LEFT JOIN a USING (model_name))
SELECT model_name, accuracy, avg_confidence, error_rate, n_alerts, n_high,
  CASE WHEN n_high > 0 THEN 'Critical' WHEN n_alerts > 0 THEN 'Warning' ELSE 'Good' END AS performance_status,
  CASE WHEN {REC_SQL} = '' THEN 'Model performance is within acceptable ranges' ELSE {REC_SQL} END AS recommendations
FROM j
"""


def q_degradation(spark, sf):
    return M.mon_degradation(_preds(spark, sf))


def q_metrics(spark, sf):
    return M.mon_metrics(_preds(spark, sf), window_hours=24)


def q_checks(spark, sf):
    return M.mon_degradation_checks(_preds(spark, sf), check_minutes=10)


def q_cooldown(spark, sf):
    return M.mon_cooldown(q_checks(spark, sf), cooldown_minutes=60)


def q_report(spark, sf):
    p = _preds(spark, sf)
    t = p.select(F.max("ts")).scalar()
    metrics = M.mon_metrics(p, as_of=t, window_hours=24)
    alerts = M.mon_degradation_checks(p).where(F.col("ts") >= t - F.make_dt_interval(F.lit(0), F.lit(24)))
    r = M.mon_report(metrics, alerts)
    return r.select("model_name", "accuracy", "avg_confidence", "error_rate", "n_alerts", "n_high",
                    "performance_status",
                    F.array_join("recommendations", " | ").alias("recommendations"))


def q_baseline(spark, sf):
    return M.mon_baseline(_preds(spark, sf))


def q_class_dist(spark, sf):
    return M.mon_class_distribution(_preds(spark, sf), window_hours=24)


def q_active(spark, sf):
    return M.mon_active_models(_preds(spark, sf))


def q_rolling(spark, sf):
    b = M.mon_rolling_buffer(_preds(spark, sf), n=1000)
    return b.groupBy("model_name", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"),
                                                  F.min("ts").alias("oldest_ts"))


def q_metrics_long(spark, sf):
    return M.metrics_long(M.mon_metrics(_preds(spark, sf), window_hours=24), window_size=24)


BASELINE_SQL = f"""
SELECT model_name, avg(CAST(is_correct AS INTEGER)) AS accuracy, avg(confidence) AS avg_confidence,
       avg(latency_ms) AS avg_latency_ms,
       CAST(count(*) FILTER (WHERE predicted_class = 'Error') AS DOUBLE) / count(*) AS error_rate
FROM v_predictions
WHERE ts >= {ASOF} - INTERVAL 25 HOUR AND ts <= {ASOF} - INTERVAL 1 HOUR
GROUP BY model_name
"""

CLASS_DIST_SQL = f"""
SELECT model_name, predicted_class, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY model_name) AS share
FROM (SELECT model_name, predicted_class, count(*) AS n FROM v_predictions
      WHERE ts >= {ASOF} - INTERVAL 24 HOUR AND ts <= {ASOF} GROUP BY ALL)
"""

ACTIVE_SQL = f"SELECT DISTINCT model_name FROM v_predictions WHERE ts > {ASOF} - INTERVAL 1 DAY"

ROLLING_SQL = """
WITH long AS (
  SELECT model_name, ts, id, 'confidence' AS metric, confidence AS value FROM v_predictions
  UNION ALL SELECT model_name, ts, id, 'latency', latency_ms FROM v_predictions
  UNION ALL SELECT model_name, ts, id, 'accuracy', CAST(CAST(is_correct AS INTEGER) AS DOUBLE)
            FROM v_predictions WHERE is_correct IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY model_name, metric ORDER BY ts DESC, id DESC) AS rn FROM long)
SELECT model_name, metric, count(*) AS n, avg(value) AS mean_value, min(ts) AS oldest_ts
FROM r WHERE rn <= 1000 GROUP BY model_name, metric
"""

METRICS_LONG_SQL = f"""
WITH m AS ({METRICS_SQL})
SELECT model_name, metric_name, metric_value, 24 AS window_size FROM (
  UNPIVOT (SELECT model_name, CAST(accuracy AS DOUBLE) AS accuracy,
      CAST(total_labeled_predictions AS DOUBLE) AS total_labeled_predictions,
      avg_confidence, min_confidence, max_confidence, confidence_std, avg_latency_ms,
      p95_latency_ms, p99_latency_ms, CAST(total_predictions AS DOUBLE) AS total_predictions,
      predictions_per_hour, error_rate FROM m)
  ON COLUMNS(* EXCLUDE (model_name)) INTO NAME metric_name VALUE metric_value)
WHERE metric_value IS NOT NULL
"""

ALERT_DBL = ("current_value", "threshold")

QUERIES = [
    Query("mon_degradation", q_degradation, DEGRADATION_SQL, ["v_predictions"], ALERT_DBL),
    Query("mon_metrics", q_metrics, METRICS_SQL, ["v_predictions"], METRIC_DBL),
    Query("mon_baseline", q_baseline, BASELINE_SQL, ["v_predictions"],
          ("accuracy", "avg_confidence", "avg_latency_ms", "error_rate")),
    Query("agg_value_shares", q_class_dist, CLASS_DIST_SQL, ["v_predictions"], ("share",)),
    Query("st_windowed_metrics", q_checks, CHECKS_SQL, ["v_predictions"], ALERT_DBL),
    Query("mon_cooldown", q_cooldown, COOLDOWN_SQL, ["v_predictions"], ALERT_DBL),
    Query("mon_report", q_report, REPORT_SQL, ["v_predictions"],
          ("accuracy", "avg_confidence", "error_rate")),
    Query("mon_active_models", q_active, ACTIVE_SQL, ["v_predictions"]),
    Query("mon_rolling_buffer", q_rolling, ROLLING_SQL, ["v_predictions"], ("mean_value",)),
    Query("snk_metrics_long", q_metrics_long, METRICS_LONG_SQL, ["v_predictions"], ("metric_value",)),
]
