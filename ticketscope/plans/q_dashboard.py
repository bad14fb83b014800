"""Dashboard queries: filters, projections, aggregates, windows, set ops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketscope.operators import aggs as A
from ticketscope.operators import windows as W
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query

ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WS = r"[ \t\n\v\f\r]+"


def _v(name):
    return lambda spark, sf: spark_view(spark, sf, name)


def _classified(spark, sf):
    """Classified tickets: v_predictions with the dashboard's column names."""
    p = spark_view(spark, sf, "v_predictions")
    return p.select(F.col("id").alias("ticket_id"), "ts",
                    F.col("predicted_class").alias("predicted_category"), "confidence", "model_name")


CLASSIFIED_SQL = """classified AS (SELECT id AS ticket_id, ts, predicted_class AS predicted_category,
                                  confidence, model_name FROM v_predictions)"""

Q = []


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


# ---------------------------------------------------------------- filters
reg("flt_required_notnull",
    lambda s, sf: A.flt_required_notnull(spark_view(s, sf, "v_tickets")).select("ticket_id", "category"),
    "SELECT ticket_id, category FROM v_tickets WHERE customer_message IS NOT NULL AND category IS NOT NULL",
    ["v_tickets"])

reg("flt_dashboard",
    lambda s, sf: A.flt_dashboard(spark_view(s, sf, "v_tickets_orders"), category="O", priority="1-URGENT"),
    "SELECT * FROM v_tickets_orders WHERE category = 'O' AND priority = '1-URGENT'", ["v_tickets_orders"])

reg("flt_dashboard_confidence",
    lambda s, sf: A.flt_dashboard(_classified(s, sf), confidence_range=(0.25, 0.75),
                                  category="Error", category_col="predicted_category"),
    f"WITH {CLASSIFIED_SQL} SELECT * FROM classified WHERE predicted_category = 'Error' "
    "AND confidence BETWEEN 0.25 AND 0.75", ["v_predictions"], ["confidence"])


def _time_window(s, sf):
    p = spark_view(s, sf, "v_predictions")
    t = p.select(F.max("ts")).scalar()
    return A.flt_time_window(p, as_of=t, days=3).select("id", "ts", "model_name")


reg("flt_time_window", _time_window,
    "SELECT id, ts, model_name FROM v_predictions WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY",
    ["v_predictions"])

reg("flt_event_types",
    lambda s, sf: A.flt_event_types(spark_view(s, sf, "v_audit"), ["access", "training"]).select("event_id", "event_type"),
    "SELECT event_id, event_type FROM v_audit WHERE event_type IN ('access', 'training')", ["v_audit"])

reg("flt_text_search",
    lambda s, sf: A.flt_text_search(spark_view(s, sf, "v_tickets"), "refund").select("ticket_id"),
    "SELECT ticket_id FROM v_tickets WHERE contains(lower(customer_message), 'refund')", ["v_tickets"])

reg("flt_high_low_confidence",
    lambda s, sf: A.flt_high_low_confidence(_classified(s, sf), 0.5),
    f"""WITH {CLASSIFIED_SQL}
    SELECT count(*) AS total, count(*) FILTER (WHERE confidence >= 0.5) AS high_confidence_count,
      count(*) FILTER (WHERE confidence < 0.5) AS low_confidence_count,
      CAST(count(*) FILTER (WHERE confidence >= 0.5) AS DOUBLE) / count(*) * 100 AS high_confidence_pct,
      CAST(count(*) FILTER (WHERE confidence < 0.5) AS DOUBLE) / count(*) * 100 AS low_confidence_pct
    FROM classified""", ["v_predictions"], ["high_confidence_pct", "low_confidence_pct"])

reg("flt_error_predictions",
    lambda s, sf: A.flt_error_predictions(spark_view(s, sf, "v_predictions")).groupBy("model_name").count(),
    "SELECT model_name, count(*) AS count FROM v_predictions WHERE predicted_class = 'Error' GROUP BY 1",
    ["v_predictions"])

reg("flt_nonempty_text",
    lambda s, sf: A.flt_nonempty_text(spark_view(s, sf, "v_tickets"), "customer_message").select("ticket_id"),
    "SELECT ticket_id FROM v_tickets WHERE length(customer_message) > 0", ["v_tickets"])

# ------------------------------------------------------------ projections
reg("prj_confidence_band",
    lambda s, sf: A.prj_confidence_band(_classified(s, sf)).select("ticket_id", "confidence_band"),
    f"""WITH {CLASSIFIED_SQL} SELECT ticket_id, CASE WHEN confidence >= 0.8 THEN 'high'
        WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_band FROM classified""",
    ["v_predictions"])

reg("prj_preview",
    lambda s, sf: A.prj_preview(spark_view(s, sf, "v_tickets")),
    """SELECT ticket_id, CASE WHEN length(customer_message) > 100
          THEN substring(customer_message, 1, 100) || '...' ELSE customer_message END AS customer_message,
          category, priority, channel, ts FROM v_tickets""", ["v_tickets"])

reg("prj_ticket_lookup",
    lambda s, sf: A.prj_ticket_lookup(spark_view(s, sf, "v_tickets"), 7),
    "SELECT * FROM v_tickets WHERE ticket_id = 7", ["v_tickets"])

reg("fn_date_parts",
    lambda s, sf: spark_view(s, sf, "v_tickets").select(
        "ticket_id", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"),
        F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).alias("days_since")),
    """SELECT ticket_id, CAST(ts AS DATE) AS date, hour(ts) AS hour,
       datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days_since FROM v_tickets""", ["v_tickets"])

# ------------------------------------------------------------ aggregations
reg("agg_value_counts",
    lambda s, sf: A.agg_value_counts(spark_view(s, sf, "v_tickets_orders"), "priority"),
    "SELECT priority, count(*) AS count FROM v_tickets_orders GROUP BY priority", ["v_tickets_orders"])

reg("agg_grouping_sets",
    lambda s, sf: A.agg_grouping_sets(spark_view(s, sf, "v_tickets"), ("category", "priority", "channel")),
    """SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(priority) = 0 THEN 'priority'
                   ELSE 'channel' END AS dimension,
              coalesce(CASE WHEN grouping(category) = 0 THEN category END,
                       CASE WHEN grouping(priority) = 0 THEN priority END,
                       CASE WHEN grouping(channel) = 0 THEN channel END) AS value,
              count(*) AS count
       FROM v_tickets GROUP BY GROUPING SETS ((category), (priority), (channel))""", ["v_tickets"])

reg("agg_overall_stats",
    lambda s, sf: A.agg_overall_stats(spark_view(s, sf, "v_tickets")),
    """SELECT count(*) AS total_tickets, count(DISTINCT category) AS unique_categories,
       count(*) FILTER (WHERE priority = 'High') AS high_priority, count(DISTINCT channel) AS channels,
       CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS date_range_days
       FROM v_tickets""", ["v_tickets"])

reg("agg_metrics_cards",
    lambda s, sf: A.agg_metrics_cards(_classified(s, sf)),
    f"""WITH {CLASSIFIED_SQL},
    c AS (SELECT predicted_category, count(*) AS n FROM classified GROUP BY 1)
    SELECT count(*) AS total_tickets, avg(confidence) AS avg_confidence,
      count(*) FILTER (WHERE confidence >= 0.8) AS high_confidence,
      CAST(count(*) FILTER (WHERE confidence >= 0.8) AS DOUBLE) / count(*) * 100 AS high_confidence_pct,
      count(*) FILTER (WHERE confidence < 0.5) AS low_confidence,
      CAST(count(*) FILTER (WHERE confidence < 0.5) AS DOUBLE) / count(*) * 100 AS low_confidence_pct,
      (SELECT predicted_category FROM c ORDER BY n DESC, predicted_category DESC LIMIT 1) AS most_common_category
    FROM classified""", ["v_predictions"], ["avg_confidence", "high_confidence_pct", "low_confidence_pct"])

reg("agg_conf_by_category",
    lambda s, sf: A.agg_conf_by_category(_classified(s, sf)),
    f"""WITH {CLASSIFIED_SQL} SELECT predicted_category, count(*) AS count, avg(confidence) AS mean_confidence,
        stddev_samp(confidence) AS std_confidence FROM classified GROUP BY 1""",
    ["v_predictions"], ["mean_confidence", "std_confidence"])

reg("agg_prediction_analysis",
    lambda s, sf: A.agg_prediction_analysis(_classified(s, sf)),
    f"""WITH {CLASSIFIED_SQL} SELECT count(*) AS total_predictions, avg(confidence) AS avg_confidence,
        min(confidence) AS min_confidence, max(confidence) AS max_confidence,
        count(*) FILTER (WHERE confidence >= 0.5) AS high_confidence_count,
        count(*) FILTER (WHERE confidence < 0.5) AS low_confidence_count FROM classified""",
    ["v_predictions"], ["avg_confidence", "min_confidence", "max_confidence"])

reg("agg_summary_report",
    lambda s, sf: A.agg_summary_report(_classified(s, sf)),
    f"""WITH {CLASSIFIED_SQL},
    g AS (SELECT predicted_category, count(*) AS count, avg(confidence) AS mean_confidence
          FROM classified GROUP BY 1),
    p AS (SELECT *, count * 100.0 / sum(count) OVER () AS percentage FROM g)
    SELECT *, printf('- **%s**: %d tickets (%.1f%%)', predicted_category, count,
                     round(percentage * 10) / 10) AS report_line FROM p""",
    ["v_predictions"], ["mean_confidence", "percentage"])

reg("agg_daily_volume",
    lambda s, sf: A.agg_daily_volume(spark_view(s, sf, "v_tickets_orders")),
    "SELECT CAST(ts AS DATE) AS date, count(*) AS count FROM v_tickets_orders GROUP BY 1",
    ["v_tickets_orders"])

reg("agg_hourly_volume",
    lambda s, sf: A.agg_hourly_volume(spark_view(s, sf, "v_predictions")),
    "SELECT hour(ts) AS hour, count(*) AS count FROM v_predictions GROUP BY 1", ["v_predictions"])

_pv = ", ".join(f"count(*) FILTER (WHERE priority = '{p}') AS \"{p}\"" for p in ORDER_PRIORITIES)
reg("agg_crosstab",
    lambda s, sf: A.agg_crosstab(spark_view(s, sf, "v_tickets_orders"), "category", "priority", ORDER_PRIORITIES),
    f"SELECT category, {_pv} FROM v_tickets_orders GROUP BY category", ["v_tickets_orders"])

reg("agg_conf_histogram",
    lambda s, sf: A.agg_conf_histogram(_classified(s, sf), 20),
    f"""WITH {CLASSIFIED_SQL},
    r AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM classified),
    b AS (SELECT CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((confidence - lo) * 20 / (hi - lo)), 19) END
                 AS INTEGER) AS bin, count(*) AS n
          FROM classified, r WHERE confidence IS NOT NULL GROUP BY 1),
    spine AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
    SELECT spine.bin, lo + spine.bin * (hi - lo) / 20 AS bin_start, lo + (spine.bin + 1) * (hi - lo) / 20 AS bin_end,
           coalesce(n, 0) AS count
    FROM spine CROSS JOIN r LEFT JOIN b ON spine.bin = b.bin""",
    ["v_predictions"], ["bin_start", "bin_end"])

reg("agg_conf_box",
    lambda s, sf: A.agg_conf_box(_classified(s, sf)),
    f"""WITH {CLASSIFIED_SQL} SELECT predicted_category, quantile_cont(confidence, 0.0) AS min,
        quantile_cont(confidence, 0.25) AS q1, quantile_cont(confidence, 0.5) AS median,
        quantile_cont(confidence, 0.75) AS q3, quantile_cont(confidence, 1.0) AS max
        FROM classified GROUP BY 1""", ["v_predictions"], ["min", "q1", "median", "q3", "max"])

_dq_cols = ["ticket_id", "customer_message", "category", "priority", "channel", "ts"]
_dq_union = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS n FROM v_tickets"
    for c in _dq_cols)
reg("agg_data_quality",
    lambda s, sf: A.agg_data_quality(spark_view(s, sf, "v_tickets")),
    f"""WITH d AS (SELECT coalesce(CAST(sum(c - 1) AS BIGINT), 0) AS dups FROM
          (SELECT count(*) AS c FROM v_tickets GROUP BY ticket_id, customer_message, category, priority, channel, ts HAVING count(*) > 1))
    SELECT column_name, missing, 1 - CAST(missing AS DOUBLE) / n AS completeness,
           (SELECT dups FROM d) AS duplicate_rows FROM ({_dq_union})""",
    ["v_tickets"], ["completeness"])

reg("agg_class_distribution",
    lambda s, sf: A.agg_class_distribution(spark_view(s, sf, "v_tickets")),
    "SELECT category, count(*) AS count FROM v_tickets GROUP BY 1", ["v_tickets"])

reg("agg_common_words",
    lambda s, sf: A.agg_common_words(spark_view(s, sf, "v_tickets"), "customer_message", 100),
    f"""WITH w AS (SELECT unnest(regexp_split_to_array(lower(customer_message), '{WS}')) AS word FROM v_tickets)
    SELECT word, count(*) AS count FROM w WHERE word <> '' GROUP BY word ORDER BY count DESC, word LIMIT 100""",
    ["v_tickets"])

reg("agg_text_ref_stats",
    lambda s, sf: A.agg_text_ref_stats(spark_view(s, sf, "v_tickets"), "customer_message"),
    f"""SELECT avg(length(customer_message)) AS avg_length,
        avg(len(list_filter(regexp_split_to_array(customer_message, '{WS}'), lambda x: x <> ''))) AS avg_word_count,
        (SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_split_to_array(lower(customer_message), '{WS}')) AS w
           FROM v_tickets) WHERE w <> '') AS vocab_size
    FROM v_tickets""", ["v_tickets"], ["avg_length", "avg_word_count"])

_fq = ", ".join(f"quantile_cont(value, {p}) AS p{int(p * 100)}" for p in [0.25, 0.5, 0.75, 0.9, 0.95, 0.99])
reg("agg_feature_ref_stats",
    lambda s, sf: A.agg_feature_ref_stats(spark_view(s, sf, "v_drift_ref"), ["value", "k"]),
    f"""WITH long AS (SELECT 'value' AS feature, value FROM v_drift_ref
                      UNION ALL SELECT 'k', k FROM v_drift_ref)
    SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, {_fq}
    FROM long GROUP BY feature""", ["v_drift_ref"],
    ["mean", "std", "min", "max", "p25", "p50", "p75", "p90", "p95", "p99"])

# ---------------------------------------------------------------- windows
reg("win_recent_results",
    lambda s, sf: W.win_recent_results(spark_view(s, sf, "v_predictions").select("id", "ts", "predicted_class"),
                                       n=20, tiebreak="id"),
    "SELECT id, ts, predicted_class FROM v_predictions ORDER BY ts DESC, id DESC LIMIT 20", ["v_predictions"])

reg("win_ema",
    lambda s, sf: W.win_ema(spark_view(s, sf, "v_predictions").select("id", "ts", "model_name", "latency_ms"),
                            value="latency_ms", group="model_name", order=["ts", "id"], alpha=0.1),
    """WITH RECURSIVE o AS (
         SELECT id, ts, model_name, latency_ms,
                row_number() OVER (PARTITION BY model_name ORDER BY ts, id) AS rn FROM v_predictions),
       e AS (SELECT model_name, rn, latency_ms AS ema FROM o WHERE rn = 1
             UNION ALL
             SELECT o.model_name, o.rn, 0.9 * e.ema + 0.1 * o.latency_ms
             FROM e JOIN o ON o.model_name = e.model_name AND o.rn = e.rn + 1)
    SELECT o.id, o.ts, o.model_name, o.latency_ms, e.ema FROM o JOIN e USING (model_name, rn)""",
    ["v_predictions"], ["latency_ms", "ema"])

reg("win_last5_of_batch",
    lambda s, sf: W.win_last_n(spark_view(s, sf, "v_predictions").select(
        "id", "ts", F.floor((F.col("id")) / 10).alias("batch")), group="batch", n=5, tiebreak="id"),
    """SELECT * FROM (SELECT id, ts, floor(id / 10) AS batch,
         row_number() OVER (PARTITION BY floor(id / 10) ORDER BY ts DESC, id DESC) AS recency_rank
       FROM v_predictions) WHERE recency_rank <= 5""", ["v_predictions"])

# ---------------------------------------------------------------- set ops


def _union(s, sf):
    from ticketscope.sources.files import src_union_sources
    a = spark_view(s, sf, "v_tickets").select("ticket_id", "category", "priority", "channel", "ts")
    b = spark_view(s, sf, "v_tickets_orders")
    u = src_union_sources([("documents", a), ("orders", b)])
    return u.groupBy("data_source", "category").agg(F.count("*").alias("n"),
                                                    F.count("channel").alias("with_channel"))


reg("set_union_all", _union,
    """WITH u AS (SELECT ticket_id, category, priority, channel, ts, 'documents' AS data_source FROM v_tickets
                  UNION ALL BY NAME
                  SELECT ticket_id, category, priority, NULL AS channel, ts, 'orders' AS data_source FROM v_tickets_orders)
    SELECT data_source, category, count(*) AS n, count(channel) AS with_channel FROM u GROUP BY 1, 2""",
    ["v_tickets", "v_tickets_orders"])

QUERIES = Q
