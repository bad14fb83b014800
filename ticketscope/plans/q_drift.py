"""Drift queries: reference = events before 2024-01-16, current = from then on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketscope.operators import drift as D
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query

Q = []
FEATURES = ["value", "k"]


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def _long(s, sf, cur="v_drift_cur"):
    return D.melt(spark_view(s, sf, "v_drift_ref"), spark_view(s, sf, cur), FEATURES)


def long_sql(cur: str = "v_drift_cur") -> str:
    parts = []
    for f in FEATURES:
        parts.append(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, 'ref' AS sample FROM v_drift_ref WHERE {f} IS NOT NULL")
        parts.append(f"SELECT '{f}', CAST({f} AS DOUBLE), 'cur' FROM {cur} WHERE {f} IS NOT NULL")
    return "long AS (" + " UNION ALL ".join(parts) + ")"


def cdf_sql(cur: str = "v_drift_cur") -> str:
    return f"""{long_sql(cur)},
    counts AS (SELECT feature, x, count(*) FILTER (WHERE sample = 'ref') AS c_ref,
                      count(*) FILTER (WHERE sample = 'cur') AS c_cur FROM long GROUP BY 1, 2),
    n AS (SELECT feature, count(*) FILTER (WHERE sample = 'ref') AS n_ref,
                 count(*) FILTER (WHERE sample = 'cur') AS n_cur FROM long GROUP BY 1),
    cdf AS (SELECT feature, x, row_number() OVER w AS rank, n_ref, n_cur,
                   CAST(sum(c_ref) OVER w AS DOUBLE) / n_ref AS F_ref, CAST(sum(c_cur) OVER w AS DOUBLE) / n_cur AS F_cur
            FROM counts JOIN n USING (feature)
            WINDOW w AS (PARTITION BY feature ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def ks_sql(cur: str = "v_drift_cur") -> str:
    return f"""WITH {cdf_sql(cur)},
    g AS (SELECT feature, max(abs(F_ref - F_cur)) AS ks_statistic, any_value(n_ref) AS n_ref, any_value(n_cur) AS n_cur
          FROM cdf GROUP BY feature),
    l AS (SELECT *, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (CAST(n_ref AS DOUBLE) + n_cur)) * ks_statistic AS lam FROM g),
    p AS (SELECT feature, ks_statistic,
                 CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * list_reduce(
                   list_transform(range(1, 101), lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam)),
                   lambda a, b: a + b))) END AS p_value FROM l)
    SELECT *, p_value < 0.05 AS drift_detected FROM p"""


def binned_sql(edges: int, cur: str = "v_drift_cur") -> str:
    nb = edges - 1
    return f"""{long_sql(cur)},
    rng AS (SELECT feature, min(x) AS lo, max(x) AS hi, count(*) FILTER (WHERE sample = 'ref') AS n_ref,
                   count(*) FILTER (WHERE sample = 'cur') AS n_cur FROM long GROUP BY 1),
    bx AS (SELECT l.feature, sample, CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((x - lo) * {nb} / (hi - lo)), {nb - 1}) END AS INTEGER) AS bin
           FROM long l JOIN rng USING (feature)),
    counts AS (SELECT feature, bin, count(*) FILTER (WHERE sample = 'ref') AS cr,
                      count(*) FILTER (WHERE sample = 'cur') AS cc FROM bx GROUP BY 1, 2),
    spine AS (SELECT feature, n_ref, n_cur, unnest(range(CASE WHEN hi - lo = 0 THEN 1 ELSE {nb} END)) AS bin FROM rng),
    b AS (SELECT s.feature, s.bin, CAST(coalesce(cr, 0) AS DOUBLE) / n_ref + 1e-10 AS r,
                 CAST(coalesce(cc, 0) AS DOUBLE) / n_cur + 1e-10 AS c
          FROM spine s LEFT JOIN counts USING (feature, bin))"""


PSI_SQL = f"WITH {binned_sql(10)} SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM b GROUP BY feature"
JS_SQL = f"""WITH {binned_sql(20)},
    n AS (SELECT *, r / sum(r) OVER (PARTITION BY feature) AS p, c / sum(c) OVER (PARTITION BY feature) AS q,
                 0.5 * (r + c) AS m FROM b),
    nm AS (SELECT *, m / sum(m) OVER (PARTITION BY feature) AS mm FROM n)
    SELECT feature, 0.5 * sum(p * ln(p / mm)) + 0.5 * sum(q * ln(q / mm)) AS js_divergence FROM nm GROUP BY feature"""
W_SQL = f"""WITH {cdf_sql()}
    SELECT a.feature, sum(abs(a.F_ref - a.F_cur) * (b.x - a.x)) AS wasserstein_distance
    FROM cdf a JOIN cdf b ON a.feature = b.feature AND b.rank = a.rank + 1 GROUP BY a.feature"""

reg("win_running_cdf", lambda s, sf: D._cdf_table(_long(s, sf)),
    f"WITH {cdf_sql()} SELECT * FROM cdf", ["v_drift_ref", "v_drift_cur"], ["x", "F_ref", "F_cur"])
reg("drift_ks", lambda s, sf: D.drift_ks(_long(s, sf)), ks_sql(), ["v_drift_ref", "v_drift_cur"],
    ["ks_statistic", "p_value"])
reg("drift_ks_shifted", lambda s, sf: D.drift_ks(_long(s, sf, "v_drift_cur_shift")), ks_sql("v_drift_cur_shift"),
    ["v_drift_ref", "v_drift_cur_shift"], ["ks_statistic", "p_value"])
reg("drift_wasserstein", lambda s, sf: D.drift_wasserstein(_long(s, sf)), W_SQL, ["v_drift_ref", "v_drift_cur"],
    ["wasserstein_distance"])
reg("drift_psi", lambda s, sf: D.drift_psi(_long(s, sf)), PSI_SQL, ["v_drift_ref", "v_drift_cur"], ["psi"])
reg("drift_psi_label",
    lambda s, sf: D.drift_psi(_long(s, sf, "v_drift_cur_shift")).select("feature", D.psi_label(F.col("psi")).alias("interpretation")),
    f"""WITH {binned_sql(10, 'v_drift_cur_shift')}
    SELECT feature, CASE WHEN psi < 0.1 THEN 'No significant change' WHEN psi < 0.2 THEN 'Minor change'
                         ELSE 'Major change - model may need retraining' END AS interpretation
    FROM (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM b GROUP BY feature)""",
    ["v_drift_ref", "v_drift_cur_shift"])
reg("drift_js", lambda s, sf: D.drift_js(_long(s, sf)), JS_SQL, ["v_drift_ref", "v_drift_cur"], ["js_divergence"])


def _chi2(s, sf):
    r = D.drift_chi2(spark_view(s, sf, "v_drift_ref"), spark_view(s, sf, "v_drift_cur"))
    return r.select("chi2_statistic", "dof", F.array_join("unseen_classes", ",").alias("unseen_classes"), "p_value",
                    "drift_detected")


def chi2_sql(cur: str = "v_drift_cur") -> str:
    """The upper tail 1 - P(dof / 2, x / 2) by the power series of the lower incomplete gamma function."""
    return f"""WITH r AS (SELECT label, count(*) AS ref_count FROM v_drift_ref GROUP BY 1),
    c AS (SELECT label, count(*) AS cur_count FROM {cur} GROUP BY 1),
    j AS (SELECT coalesce(r.label, c.label) AS label, coalesce(ref_count, 0) AS ref_count, coalesce(cur_count, 0) AS cur_count
          FROM r FULL OUTER JOIN c ON r.label = c.label),
    t AS (SELECT CAST(sum(ref_count) AS DOUBLE) AS nr, CAST(sum(cur_count) AS DOUBLE) AS nc FROM j),
    s AS (SELECT sum(CASE WHEN ref_count > 0 THEN pow(cur_count - ref_count * nc / nr, 2) / (ref_count * nc / nr) END) AS chi2_statistic,
           count(*) FILTER (WHERE ref_count > 0) - 1 AS dof,
           coalesce(array_to_string(list_sort(list(label) FILTER (WHERE ref_count = 0)), ','), '') AS unseen_classes
          FROM j, t),
    p AS (SELECT *, CASE WHEN chi2_statistic <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1.0 - list_sum(list_transform(range(0, 1000),
              lambda i: exp((dof / 2.0 + i) * ln(chi2_statistic / 2.0) - chi2_statistic / 2.0 - lgamma(dof / 2.0 + i + 1)))))) END AS p_value FROM s)
    SELECT *, p_value < 0.05 AS drift_detected FROM p"""


reg("drift_chi2", _chi2, chi2_sql(), ["v_drift_ref", "v_drift_cur"], ["chi2_statistic", "p_value"])


def domain_sql(cur: str = "v_drift_cur") -> str:
    """The cross-fitted domain classifier; features one after the other, as a long table."""
    bins, grid = D.DOMAIN_BINS, D.DOMAIN_GRID
    return f"""WITH b AS (SELECT 'ref' AS sample, CAST(id AS VARCHAR) AS id, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)} FROM v_drift_ref
              UNION ALL SELECT 'cur', CAST(id AS VARCHAR), {', '.join(f'CAST({f} AS DOUBLE)' for f in FEATURES)} FROM {cur}),
    h AS (SELECT *, CASE WHEN md5(sample || ':' || id) < '8' THEN 0 ELSE 1 END AS half FROM b),
    l AS ({' UNION ALL '.join(f"SELECT sample, id, half, '{f}' AS feature, {f} AS x FROM h" for f in FEATURES)}),
    g AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1),
    bx AS (SELECT l.*, CAST(CASE WHEN x IS NULL THEN -1 WHEN hi = lo THEN 0
               ELSE least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) END AS INTEGER) AS bin FROM l JOIN g USING (feature)),
    n AS (SELECT half, count(*) FILTER (WHERE sample = 'ref') AS n_ref, count(*) FILTER (WHERE sample = 'cur') AS n_cur FROM h GROUP BY 1),
    o AS (SELECT 1 - half AS half, feature, bin,
                 CAST(round((ln((count(*) FILTER (WHERE sample = 'cur') + 1.0) / (any_value(n_cur) + {bins}))
                           - ln((count(*) FILTER (WHERE sample = 'ref') + 1.0) / (any_value(n_ref) + {bins}))) * {grid}) AS BIGINT) AS v
          FROM bx JOIN n USING (half) GROUP BY half, feature, bin),
    s AS (SELECT sample, id, sum(coalesce(v, 0)) AS score FROM bx LEFT JOIN o USING (half, feature, bin) GROUP BY 1, 2),
    c AS (SELECT score, CAST(count(*) FILTER (WHERE sample = 'ref') AS DOUBLE) AS c_ref, CAST(count(*) FILTER (WHERE sample = 'cur') AS DOUBLE) AS c_cur
          FROM s GROUP BY 1),
    r AS (SELECT *, sum(c_ref) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below FROM c),
    a AS (SELECT CAST(sum(c_ref + c_cur) AS BIGINT) AS n, sum(c_cur * (below - c_ref / 2)) / (sum(c_cur) * sum(c_ref)) AS auc FROM r)
    SELECT *, auc > 0.7 AS drift_detected FROM a"""


for _name, _cur in (("drift_domain_classifier", "v_drift_cur"), ("drift_domain_classifier_shifted", "v_drift_cur_shift")):
    reg(_name, lambda s, sf, c=_cur: D.drift_domain_classifier(spark_view(s, sf, "v_drift_ref"), spark_view(s, sf, c), FEATURES),
        domain_sql(_cur), ["v_drift_ref", _cur], ["auc"])


def report_sql(cur: str) -> str:
    return f"""WITH ks AS ({ks_sql(cur)}),
    psi AS (WITH {binned_sql(10, cur)} SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM b GROUP BY feature),
    js AS ({JS_SQL.replace('v_drift_cur', cur)}),
    w AS ({W_SQL.replace('v_drift_cur', cur)}),
    sd AS (SELECT (stddev_pop(value) + stddev_pop(k)) / 2 AS s FROM v_drift_ref)
    SELECT 'ks_test' AS method, avg(p_value) AS score, bool_or(drift_detected) AS drift_detected FROM ks
    UNION ALL SELECT 'psi', avg(psi), avg(psi) > 0.1 FROM psi
    UNION ALL SELECT 'js_divergence', avg(js_divergence), avg(js_divergence) > 0.1 FROM js
    UNION ALL SELECT 'wasserstein', avg(wasserstein_distance) / (SELECT s FROM sd),
                     avg(wasserstein_distance) / (SELECT s FROM sd) > 0.1 FROM w
    UNION ALL SELECT 'chi2_test', p_value, drift_detected FROM ({chi2_sql(cur)})
    UNION ALL SELECT 'covariate_shift', auc, drift_detected FROM ({domain_sql(cur)})"""


def _report(cur):
    return lambda s, sf: D.drift_report(spark_view(s, sf, "v_drift_ref"), spark_view(s, sf, cur), FEATURES)


reg("drift_report", _report("v_drift_cur"), report_sql("v_drift_cur"), ["v_drift_ref", "v_drift_cur"], ["score"])
reg("drift_report_shifted", _report("v_drift_cur_shift"), report_sql("v_drift_cur_shift"),
    ["v_drift_ref", "v_drift_cur_shift"], ["score"])
reg("drift_assess", lambda s, sf: D.drift_assess(_report("v_drift_cur_shift")(s, sf)),
    f"""WITH rep AS ({report_sql('v_drift_cur_shift')})
    SELECT avg(CAST(drift_detected AS INTEGER)) AS drift_score, count(*) FILTER (WHERE drift_detected) AS methods_detecting_drift,
           count(*) AS total_methods, avg(CAST(drift_detected AS INTEGER)) > 0.5 AS overall_drift_detected,
           CASE WHEN avg(CAST(drift_detected AS INTEGER)) > 0.7 THEN 'high' ELSE 'medium' END AS severity FROM rep""",
    ["v_drift_ref", "v_drift_cur_shift"], ["drift_score"])

QUERIES = Q
