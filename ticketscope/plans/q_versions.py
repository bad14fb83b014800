"""Registry, A/B test, routing and comparison queries (v_registry, v_ab_log, v_requests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketscope.operators import versions as V
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query

Q = []

# Fixture A/B configuration (two overlapping tests: the first active one wins).
TESTS = [
    {"test_id": "ab_test_m1_vs_m0_20240105_000000", "model_a": "m0", "model_b": "m1", "traffic_split": 0.3,
     "start_date": "2024-01-05 00:00:00", "end_date": "2024-01-25 00:00:00",
     "success_metrics": ["confidence", "latency_ms"], "min_sample_size": 100, "significance_level": 0.05},
    {"test_id": "ab_test_late", "model_a": "m1", "model_b": "m2", "traffic_split": 0.5,
     "start_date": "2024-01-20 00:00:00", "end_date": None,
     "success_metrics": ["confidence"], "min_sample_size": 100, "significance_level": 0.05},
]


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def _reg(s, sf):
    return V.with_version_id(spark_view(s, sf, "v_registry"))


VID_SQL = ("model_name || '_v' || version || '_' || substring(md5(model_name || '_' || version || '_' || "
           "strftime(creation_date, '%Y%m%d_%H%M%S')), 1, 8)")
REG_SQL = f"reg AS (SELECT *, {VID_SQL} AS version_id FROM v_registry)"

reg("prj_version_id", lambda s, sf: _reg(s, sf).select("part_key", "version_id"),
    f"WITH {REG_SQL} SELECT part_key, version_id FROM reg", ["v_registry"])
reg("ver_list", lambda s, sf: V.ver_list(_reg(s, sf), "Brand#1").select("part_key", "version"),
    "SELECT part_key, version FROM v_registry WHERE model_name = 'Brand#1'", ["v_registry"])
reg("win_latest_version", lambda s, sf: V.win_latest_version(_reg(s, sf)).select("model_name", "version", "creation_date"),
    """SELECT model_name, version, creation_date FROM (SELECT *, row_number() OVER (PARTITION BY model_name
       ORDER BY creation_date DESC, version DESC) AS r FROM v_registry) WHERE r = 1""", ["v_registry"])
reg("win_best_version",
    lambda s, sf: V.win_best_version(_reg(s, sf), "accuracy").select("model_name", "version", "metric_value"),
    """SELECT model_name, version, accuracy AS metric_value FROM (SELECT *, row_number() OVER (PARTITION BY model_name
       ORDER BY accuracy DESC, creation_date, version) AS r FROM v_registry) WHERE r = 1""", ["v_registry"],
    ["metric_value"])


def _rollback(s, sf):
    r = _reg(s, sf)
    deployed = V.win_latest_version(r).select("model_name", "version")
    return V.win_rollback_target(r, deployed).select("model_name", "version", "creation_date", "deployed_version")


reg("win_rollback_target", _rollback,
    """WITH d AS (SELECT model_name, version AS deployed_version, creation_date AS deployed_created FROM
         (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY creation_date DESC, version DESC) AS r
          FROM v_registry) WHERE r = 1),
    o AS (SELECT v.model_name, v.version, v.creation_date, d.deployed_version,
                 row_number() OVER (PARTITION BY v.model_name ORDER BY v.creation_date DESC, v.version DESC) AS r
          FROM v_registry v JOIN d ON v.model_name = d.model_name AND v.creation_date < d.deployed_created)
    SELECT model_name, version, creation_date, deployed_version FROM o WHERE r = 1""", ["v_registry"])

reg("win_next_version", lambda s, sf: V.win_next_version(_reg(s, sf)),
    """WITH p AS (SELECT model_name, string_split(version, '.') AS parts FROM v_registry),
    m AS (SELECT model_name, max([CAST(parts[1] AS BIGINT), CAST(parts[2] AS BIGINT), CAST(parts[3] AS BIGINT)]) AS mx
          FROM p WHERE len(parts) = 3 GROUP BY 1)
    SELECT n.model_name, coalesce(CAST(mx[1] AS VARCHAR) || '.' || CAST(mx[2] AS VARCHAR) || '.' || CAST(mx[3] + 1 AS VARCHAR),
                                  '1.0.0') AS next_version
    FROM (SELECT DISTINCT model_name FROM v_registry) n LEFT JOIN m USING (model_name)""", ["v_registry"])

BUCKET_SQL = """(((((CAST(('0x' || substr(md5(request_id), 1, 8)) AS BIGINT)) % 100 * 96
                  + CAST(('0x' || substr(md5(request_id), 9, 8)) AS BIGINT)) % 100 * 96
                  + CAST(('0x' || substr(md5(request_id), 17, 8)) AS BIGINT)) % 100 * 96
                  + CAST(('0x' || substr(md5(request_id), 25, 8)) AS BIGINT)) % 100) / 100.0"""
ROUTE_SQL = f"""routed AS (
  SELECT request_id, ts, {BUCKET_SQL} AS random_value FROM v_requests),
r2 AS (SELECT *,
  CASE WHEN ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00' THEN 'ab_test_m1_vs_m0_20240105_000000'
       WHEN ts >= TIMESTAMP '2024-01-20 00:00:00' THEN 'ab_test_late' END AS test_id,
  CASE WHEN ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'
         THEN CASE WHEN random_value < 0.3 THEN 'm1' ELSE 'm0' END
       WHEN ts >= TIMESTAMP '2024-01-20 00:00:00' THEN CASE WHEN random_value < 0.5 THEN 'm2' ELSE 'm1' END
       ELSE 'default' END AS model_chosen FROM routed)"""


def _route(s, sf):
    return V.ab_route(spark_view(s, sf, "v_requests"), TESTS)


reg("ab_route", _route, f"WITH {ROUTE_SQL} SELECT * FROM r2", ["v_requests"], ["random_value"])
reg("fn_hash_md5_bucket",
    lambda s, sf: _route(s, sf).select("request_id", "random_value"),
    f"WITH {ROUTE_SQL} SELECT request_id, random_value FROM r2", ["v_requests"], ["random_value"])
reg("join_routing_active", lambda s, sf: _route(s, sf).groupBy("test_id").count(),
    f"WITH {ROUTE_SQL} SELECT test_id, count(*) AS count FROM r2 GROUP BY 1", ["v_requests"])
reg("agg_routing_stats", lambda s, sf: V.agg_routing_stats(_route(s, sf), TESTS),
    f"""WITH {ROUTE_SQL},
    cfg AS (SELECT * FROM (VALUES ('ab_test_m1_vs_m0_20240105_000000', 'm0', 'm1', 30.0),
                                  ('ab_test_late', 'm1', 'm2', 50.0)) t(test_id, a, b, expected_split))
    SELECT cfg.test_id, count(r2.test_id) AS total_requests,
           count(*) FILTER (WHERE model_chosen = a) AS model_a_count, count(*) FILTER (WHERE model_chosen = b) AS model_b_count,
           coalesce(count(*) FILTER (WHERE model_chosen = a) * 100.0 / nullif(count(r2.test_id), 0), 0.0) AS model_a_percentage,
           coalesce(count(*) FILTER (WHERE model_chosen = b) * 100.0 / nullif(count(r2.test_id), 0), 0.0) AS model_b_percentage,
           any_value(expected_split) AS expected_split,
           coalesce(count(*) FILTER (WHERE model_chosen = b) * 100.0 / nullif(count(r2.test_id), 0), 0.0) AS actual_split
    FROM cfg LEFT JOIN r2 ON r2.test_id = cfg.test_id GROUP BY cfg.test_id""", ["v_requests"],
    ["model_a_percentage", "model_b_percentage", "expected_split", "actual_split"])


def _ab(s, sf):
    return V.ab_results(spark_view(s, sf, "v_ab_log"), TESTS[0]).select(
        "metric", "n_a", "n_b", "model_a_mean", "model_b_mean", "model_a_std", "model_b_std", "improvement",
        "t_statistic", "dof")


reg("ab_results", _ab,
    """WITH d AS (SELECT version_id, 'confidence' AS metric, confidence AS v FROM v_ab_log
                  WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
                  UNION ALL SELECT version_id, 'latency_ms', latency_ms FROM v_ab_log
                  WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'),
    g AS (SELECT metric, count(*) FILTER (WHERE version_id = 'm0') AS n_a, count(*) FILTER (WHERE version_id = 'm1') AS n_b,
                 avg(v) FILTER (WHERE version_id = 'm0') AS model_a_mean, avg(v) FILTER (WHERE version_id = 'm1') AS model_b_mean,
                 stddev_pop(v) FILTER (WHERE version_id = 'm0') AS model_a_std, stddev_pop(v) FILTER (WHERE version_id = 'm1') AS model_b_std,
                 var_samp(v) FILTER (WHERE version_id = 'm0') AS va, var_samp(v) FILTER (WHERE version_id = 'm1') AS vb
          FROM d GROUP BY metric)
    SELECT metric, n_a, n_b, model_a_mean, model_b_mean, model_a_std, model_b_std,
           (model_b_mean - model_a_mean) / model_a_mean * 100 AS improvement,
           (model_a_mean - model_b_mean) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b))
             AS t_statistic, n_a + n_b - 2 AS dof
    FROM g""", ["v_ab_log"],
    ["model_a_mean", "model_b_mean", "model_a_std", "model_b_std", "improvement", "t_statistic"])


def _rec(s, sf):
    res = V.ab_results(spark_view(s, sf, "v_ab_log"), TESTS[0])
    return V.ab_recommend(res, TESTS[0])


reg("ab_recommend", _rec)


def _invalid(s, sf):
    cfg = s.createDataFrame([(t["test_id"], t["model_a"], t["model_b"]) for t in TESTS],
                            "test_id string, model_a string, model_b string")
    versions = spark_view(s, sf, "v_ab_log").select("version_id").distinct()
    return V.ab_create(cfg, versions).select("test_id")


reg("ab_create", _invalid,
    """WITH cfg AS (SELECT * FROM (VALUES ('ab_test_m1_vs_m0_20240105_000000', 'm0', 'm1'), ('ab_test_late', 'm1', 'm2'))
                    t(test_id, model_a, model_b)),
    ids AS (SELECT DISTINCT version_id FROM v_ab_log)
    SELECT DISTINCT test_id FROM cfg WHERE model_a NOT IN (SELECT version_id FROM ids)
                                        OR model_b NOT IN (SELECT version_id FROM ids)""", ["v_ab_log"])


def _compare(s, sf):
    r = V.ver_compare(spark_view(s, sf, "v_ab_log"), ["m0", "m1"], ["confidence", "latency_ms"])
    return r.select("version_id", "metric", "mean", "std", "n", "trend", "is_best")


reg("ver_compare", _compare,
    """WITH t AS (SELECT max(ts) AS t FROM v_ab_log),
    d AS (SELECT version_id, ts, 'confidence' AS metric, confidence AS value FROM v_ab_log, t WHERE ts > t.t - INTERVAL 7 DAY
          UNION ALL SELECT version_id, ts, 'latency_ms', latency_ms FROM v_ab_log, t WHERE ts > t.t - INTERVAL 7 DAY),
    g AS (SELECT version_id, metric, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n,
                 CASE WHEN count(*) > 1 AND arg_max(value, ts) > arg_min(value, ts) THEN 'improving' ELSE 'stable' END AS trend
          FROM d GROUP BY 1, 2)
    SELECT *, version_id = arg_max(version_id, (mean, version_id)) OVER (PARTITION BY metric) AS is_best FROM g""",
    ["v_ab_log"], ["mean", "std"])

reg("win_first_last_trend",
    lambda s, sf: _compare(s, sf).select("version_id", "metric", "trend"),
    """WITH t AS (SELECT max(ts) AS t FROM v_ab_log),
    d AS (SELECT version_id, ts, 'confidence' AS metric, confidence AS value FROM v_ab_log, t WHERE ts > t.t - INTERVAL 7 DAY
          UNION ALL SELECT version_id, ts, 'latency_ms', latency_ms FROM v_ab_log, t WHERE ts > t.t - INTERVAL 7 DAY)
    SELECT version_id, metric, CASE WHEN count(*) > 1 AND arg_max(value, ts) > arg_min(value, ts) THEN 'improving'
                                    ELSE 'stable' END AS trend FROM d GROUP BY 1, 2""", ["v_ab_log"])

reg("win_perf_trend", lambda s, sf: V.win_perf_trend(spark_view(s, sf, "v_ab_log"), "m1", "latency_ms", days=30),
    """SELECT ts, latency_ms AS value FROM v_ab_log
       WHERE version_id = 'm1' AND ts > (SELECT max(ts) FROM v_ab_log) - INTERVAL 30 DAY""", ["v_ab_log"], ["value"])


def _join_reg_logs(s, sf):
    logs = spark_view(s, sf, "v_ab_log")
    versions = logs.select("version_id").distinct().withColumn("status", F.lit("active"))
    return V.join_registry_logs(versions, logs).groupBy("version_id", "status").agg(F.count("*").alias("n_logs"))


reg("join_registry_logs", _join_reg_logs,
    """SELECT version_id, 'active' AS status, count(*) AS n_logs FROM v_ab_log
       WHERE ts > (SELECT max(ts) FROM v_ab_log) - INTERVAL 7 DAY GROUP BY 1""", ["v_ab_log"])

QUERIES = Q
