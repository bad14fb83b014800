"""Audit, compliance and GDPR queries over v_audit / v_rules / v_gdpr."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketscope.operators import audit as AU
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query

Q = []


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def _ev(s, sf):
    return spark_view(s, sf, "v_audit")


def _viol(s, sf):
    return AU.aud_rule_eval(_ev(s, sf), spark_view(s, sf, "v_rules"))


ASOF = "(SELECT max(ts) FROM events)"
VIOL_SQL = f"""viol AS (
  SELECT 'data_retention:' || CAST(event_id AS VARCHAR) AS violation_id, {ASOF} AS ts,
         'data_retention' AS rule_id, event_id, 'high' AS severity,
         'Event exceeds retention period of 15 days' AS description, false AS resolved
  FROM v_audit WHERE floor((epoch_us({ASOF}) - epoch_us(ts)) / 86400000000) > 15
  UNION ALL
  SELECT 'bias_monitoring:' || CAST(event_id AS VARCHAR), ts, 'bias_monitoring', event_id, 'high',
         'Potential bias detected in prediction', false
  FROM v_audit WHERE event_type = 'prediction' AND coalesce(confidence, 1.0) < 0.5)"""
PERIOD = f"ts BETWEEN {ASOF} - INTERVAL 30 DAY AND {ASOF}"

reg("aud_rule_eval", _viol, f"WITH {VIOL_SQL} SELECT * FROM viol", ["v_audit"])
reg("join_rule_event",
    lambda s, sf: _viol(s, sf).groupBy("rule_id").agg(F.count("*").alias("violations")),
    f"WITH {VIOL_SQL} SELECT rule_id, count(*) AS violations FROM viol GROUP BY 1", ["v_audit"])

reg("agg_audit_event_stats", lambda s, sf: AU.agg_audit_event_stats(_ev(s, sf)),
    f"SELECT event_type, count(*) AS count FROM v_audit WHERE {PERIOD} GROUP BY 1", ["v_audit"])

reg("win_top_users", lambda s, sf: AU.agg_audit_top_users(_ev(s, sf)),
    f"""SELECT user_id, count(*) AS activity_count FROM v_audit WHERE {PERIOD} AND user_id IS NOT NULL
        GROUP BY 1 ORDER BY activity_count DESC, user_id LIMIT 10""", ["v_audit"])

reg("agg_audit_model_usage", lambda s, sf: AU.agg_audit_model_usage(_ev(s, sf)),
    f"SELECT model_id, count(*) AS count FROM v_audit WHERE {PERIOD} GROUP BY 1", ["v_audit"])

reg("agg_audit_violations",
    lambda s, sf: AU.agg_audit_violations(_viol(s, sf), as_of=_ev(s, sf).select(F.max("ts")).scalar()),
    f"WITH {VIOL_SQL} SELECT rule_id, severity, count(*) AS count FROM viol WHERE {PERIOD} GROUP BY 1, 2",
    ["v_audit"])


def _report(s, sf):
    ev = _ev(s, sf)
    t = ev.select(F.max("ts")).scalar()
    return AU.aud_report(ev, _viol(s, sf), as_of=t)


reg("aud_report", _report,
    f"""WITH {VIOL_SQL}
    SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users,
           count(DISTINCT model_id) AS models_accessed,
           (SELECT count(*) FROM viol WHERE {PERIOD}) AS compliance_violations
    FROM v_audit WHERE {PERIOD}""", ["v_audit"])

reg("aud_report_filtered",
    lambda s, sf: AU.agg_audit_event_stats(_ev(s, sf), event_types=["prediction", "access"],
                                           start=F.lit("2024-01-10").cast("timestamp_ntz"),
                                           end=F.lit("2024-01-20").cast("timestamp_ntz")),
    """SELECT event_type, count(*) AS count FROM v_audit
       WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'
         AND event_type IN ('prediction', 'access') GROUP BY 1""", ["v_audit"])


def _recent(s, sf):
    t = _ev(s, sf).select(F.max("ts")).scalar()
    return AU.agg_recent_violations(_viol(s, sf), as_of=t)


reg("agg_recent_violations", _recent,
    f"""WITH {VIOL_SQL} SELECT severity, count(*) FILTER (WHERE ts > {ASOF} - INTERVAL 7 DAY) AS recent_count,
        count(*) FILTER (WHERE NOT resolved) AS unresolved FROM viol GROUP BY 1""", ["v_audit"])


def _status(s, sf):
    t = _ev(s, sf).select(F.max("ts")).scalar()
    return AU.aud_status(spark_view(s, sf, "v_rules"), _viol(s, sf), as_of=t)


reg("aud_status", _status,
    f"""WITH {VIOL_SQL},
    v AS (SELECT rule_id, count(*) FILTER (WHERE ts > {ASOF} - INTERVAL 7 DAY) AS recent_violations,
                 count(*) FILTER (WHERE NOT resolved) AS unresolved_violations FROM viol GROUP BY 1)
    SELECT r.rule_id, r.name, r.enabled, r.severity, coalesce(v.recent_violations, 0) AS recent_violations,
           coalesce(v.unresolved_violations, 0) AS unresolved_violations
    FROM v_rules r LEFT JOIN v USING (rule_id)""", ["v_audit", "v_rules"])



def _purge(s, sf):
    ev = _ev(s, sf)
    # a violation is dated by its event here, so that some are older than the cutoff
    dated = _viol(s, sf).drop("ts").join(ev.select("event_id", "ts"), "event_id")
    return AU.aud_retention_purge({"events": ev, "violations": dated}, retention_days=15)[1]


reg("aud_retention_purge", _purge,
    f"""WITH {VIOL_SQL},
    m AS (SELECT 'events' AS source, ts FROM v_audit
          UNION ALL SELECT 'violations', a.ts FROM viol JOIN v_audit a USING (event_id)),
    n AS (SELECT source, count(*) FILTER (WHERE ts < {ASOF} - INTERVAL 15 DAY) AS deleted_count,
                 count(*) FILTER (WHERE ts >= {ASOF} - INTERVAL 15 DAY) AS kept_count FROM m GROUP BY 1)
    SELECT * FROM n UNION ALL
    SELECT 'total', CAST(sum(deleted_count) AS BIGINT), CAST(sum(kept_count) AS BIGINT) FROM n""", ["v_audit"])

IDS_SQL = """ids AS (SELECT DISTINCT request_id, request_type, identity FROM
  (SELECT request_id, request_type, unnest(list_filter([user_id, email], lambda x: x IS NOT NULL)) AS identity
   FROM v_gdpr))"""

reg("join_gdpr_or",
    lambda s, sf: AU.aud_gdpr_counts(_ev(s, sf), spark_view(s, sf, "v_gdpr")),
    f"""WITH {IDS_SQL},
    m AS (SELECT request_id, count(*) AS total_events FROM ids JOIN v_audit a ON a.user_id = ids.identity GROUP BY 1)
    SELECT g.request_id, g.request_type, g.user_id, g.email, coalesce(m.total_events, 0) AS total_events
    FROM v_gdpr g LEFT JOIN m USING (request_id)""", ["v_audit", "v_gdpr"])

reg("aud_gdpr_access",
    lambda s, sf: AU.aud_gdpr_access(_ev(s, sf), spark_view(s, sf, "v_gdpr")).select(
        "request_id", "request_type", "event_id", "event_type", "user_id", "model_id"),
    f"""WITH {IDS_SQL}
    SELECT ids.request_id, ids.request_type, a.event_id, a.event_type, a.user_id, a.model_id
    FROM ids JOIN v_audit a ON a.user_id = ids.identity
    WHERE ids.request_type IN ('access', 'portability')""", ["v_audit", "v_gdpr"])

reg("join_gdpr_erase",
    lambda s, sf: AU.join_gdpr_erase(_ev(s, sf), spark_view(s, sf, "v_gdpr"))
    .groupBy("event_type").agg(F.count("*").alias("remaining")),
    f"""WITH {IDS_SQL}
    SELECT event_type, count(*) AS remaining FROM v_audit a
    WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.request_type = 'deletion' AND ids.identity = a.user_id)
    GROUP BY 1""", ["v_audit", "v_gdpr"])

reg("aud_gdpr_process",
    lambda s, sf: AU.aud_gdpr_process(_ev(s, sf), spark_view(s, sf, "v_gdpr")),
    f"""WITH {IDS_SQL},
    m AS (SELECT request_id, count(*) AS n FROM ids JOIN v_audit a ON a.user_id = ids.identity GROUP BY 1)
    SELECT g.request_id, g.request_type,
      CASE g.request_type WHEN 'access' THEN 'data' WHEN 'deletion' THEN 'deleted_records'
           WHEN 'portability' THEN 'exportable_data' ELSE 'error: Unsupported request type: ' || g.request_type END
        AS response_kind,
      coalesce(m.n, 0) AS affected_records, 'completed' AS status
    FROM v_gdpr g LEFT JOIN m USING (request_id) WHERE g.status = 'pending'""", ["v_audit", "v_gdpr"])

reg("prj_sha256",
    lambda s, sf: spark_view(s, sf, "v_predictions").select("id", AU.prj_sha256(F.col("input_text")).alias("input_hash")),
    "SELECT id, sha256(input_text) AS input_hash FROM v_predictions", ["v_predictions"])


def _event_build(s, sf):
    p = spark_view(s, sf, "v_predictions").select(
        "ts", F.col("model_name").alias("model_id"), "input_text",
        F.col("predicted_class").alias("prediction"), "confidence", "user_id")
    e = AU.prj_event_build(p, kind="prediction")
    return e.select("event_id", "event_type", "user_id", "model_id", "input_data_hash",
                    F.array_join("compliance_tags", ",").alias("tags"),
                    F.col("data_lineage.source_type").alias("lineage_source"),
                    F.col("data_lineage.data_hash").alias("lineage_hash"),
                    F.col("output_data")["prediction"].alias("prediction"))


reg("prj_event_build", _event_build,
    """SELECT sha256(concat_ws('|', 'prediction', model_name, CAST(user_id AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR),
                               sha256(input_text))) AS event_id,
              'prediction' AS event_type, CAST(user_id AS VARCHAR) AS user_id, model_name AS model_id,
              sha256(input_text) AS input_data_hash, 'prediction,gdpr_relevant' AS tags,
              'user_input' AS lineage_source, sha256(input_text) AS lineage_hash, predicted_class AS prediction
       FROM v_predictions""", ["v_predictions"])

QUERIES = Q
