"""Remaining inventory rows: sinks/state round trips, small joins, scalar
functions, pruned TF-IDF, drift follow-ups, GDPR delete, custom templates."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ticketscope.functions import text as T
from ticketscope.operators import aggs as A
from ticketscope.operators import audit as AU
from ticketscope.operators import drift as D
from ticketscope.operators import ensemble as E
from ticketscope.operators import features as FE
from ticketscope.operators import monitor as M
from ticketscope.operators import responses as R
from ticketscope.operators import versions as V
from ticketscope.operators.windows import srt_probabilities, top_n_per_group
from ticketscope.plans import q_monitor, q_text, q_ensemble, q_drift, q_audit
from ticketscope.plans.fixtures import VOTE_CLASSES, spark_view
from ticketscope.plans.registry import Query
from ticketscope.session import materialize
from ticketscope.sources import sinks as SK
from ticketscope.streaming.jobs import scratch

Q = []


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def _fresh(s, name):
    return scratch(s, f"x-{name}-{uuid.uuid4().hex}")


def lit(x):
    return "'" + x.replace("'", "''") + "'"


# ------------------------------------------------------------ sinks / state

def _append_audit(s, sf):
    base = _fresh(s, "audit")
    p = spark_view(s, sf, "v_predictions").select("ts", F.col("model_name").alias("model_id"), "input_text",
                                                   F.col("predicted_class").alias("prediction"), "confidence", "user_id")
    SK.snk_append(AU.prj_event_build(p, kind="prediction"), base)
    return s.read.parquet(base).groupBy("date", "event_type").agg(F.count("*").alias("n"))


reg("snk_append_audit", _append_audit,
    "SELECT CAST(ts AS DATE) AS date, 'prediction' AS event_type, count(*) AS n FROM v_predictions GROUP BY 1",
    ["v_predictions"])


def _append_feedback(s, sf):
    base = _fresh(s, "fb")
    SK.snk_append(spark_view(s, sf, "v_feedback"), base)
    return s.read.parquet(base).groupBy("date").agg(F.count("*").alias("n"))


reg("snk_append_feedback", _append_feedback,
    "SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM v_feedback GROUP BY 1", ["v_feedback"])


def _append_perf(s, sf):
    base = _fresh(s, "perf")
    SK.snk_append(spark_view(s, sf, "v_ab_log"), base)
    r = s.read.parquet(base)
    return r.groupBy("version_id").agg(F.count("*").alias("n"), F.avg(F.col("metrics")["confidence"]).alias("conf"))


reg("snk_append_perf_log", _append_perf,
    "SELECT version_id, count(*) AS n, avg(confidence) AS conf FROM v_ab_log GROUP BY 1", ["v_ab_log"], ["conf"])


def _model_history(s, sf):
    h = q_ensemble._history(s, sf)
    return E.snk_append_model_history(h.limit(0), h, keep=10).groupBy("model").agg(F.count("*").alias("kept"))


reg("snk_append_model_history", _model_history,
    f"""WITH {q_ensemble.HIST_SQL} SELECT model, least(count(*), 10) AS kept FROM hist GROUP BY 1""",
    ["v_votes", "v_predictions"])


def _export_metrics(s, sf):
    base = _fresh(s, "metrics")
    p = spark_view(s, sf, "v_predictions")
    t = p.select(F.max("ts")).scalar()
    long = M.metrics_long(M.mon_metrics(p, as_of=t), window_size=24).withColumn("ts", t)
    SK.snk_export_metrics(long, base + "/metrics.json", as_of=t, hours=24)
    r = s.read.schema("model_name string, metric_name string, metric_value double, window_size int").json(base + "/metrics.json")
    return r.select("model_name", "metric_name", "metric_value", F.col("window_size").cast("int").alias("window_size"))


reg("snk_export_metrics", _export_metrics, q_monitor.METRICS_LONG_SQL, ["v_predictions"], ["metric_value"])


def _export_feedback(s, sf):
    base = _fresh(s, "fbx")
    fb = spark_view(s, sf, "v_feedback")
    t = fb.select(F.max("ts")).scalar()
    SK.export(fb.where(F.col("ts") > t - F.make_dt_interval(F.lit(7))), base + "/fb.csv", order=[F.desc("ts")])
    r = s.read.option("header", True).schema(fb.schema).csv(base + "/fb.csv")
    return r.groupBy("true_category").agg(F.count("*").alias("n"))


reg("snk_export_feedback", _export_feedback,
    """SELECT true_category, count(*) AS n FROM v_feedback WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY
       GROUP BY 1""", ["v_feedback"])


def _export_results(s, sf):
    base = _fresh(s, "res")
    p = spark_view(s, sf, "v_predictions").select(F.col("id").alias("ticket_id"), "predicted_class", "confidence")
    SK.export(p, base + "/results.csv")
    r = s.read.option("header", True).schema(p.schema).csv(base + "/results.csv")
    return r.groupBy("predicted_class").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))


reg("snk_export_results", _export_results,
    "SELECT predicted_class, count(*) AS n, avg(confidence) AS c FROM v_predictions GROUP BY 1", ["v_predictions"], ["c"])


def _state_feedback(s, sf):
    base = _fresh(s, "sfb")
    SK.save_state(spark_view(s, sf, "v_feedback"), base)
    return SK.load_state(s, base).groupBy("predicted_category").agg(F.count("*").alias("n"))


reg("state_feedback", _state_feedback,
    "SELECT predicted_category, count(*) AS n FROM v_feedback GROUP BY 1", ["v_feedback"])


def _ens_state(s, sf):
    base = _fresh(s, "ens")
    SK.save_state(q_ensemble._history(s, sf), base)
    return SK.load_state(s, base).groupBy("model").agg(F.count("*").alias("n"), F.avg("accuracy").alias("acc"))


reg("ens_config_state", _ens_state,
    f"WITH {q_ensemble.HIST_SQL} SELECT model, count(*) AS n, avg(accuracy) AS acc FROM hist GROUP BY 1",
    ["v_votes", "v_predictions"], ["acc"])


def _alert_store(s, sf):
    base = _fresh(s, "alerts")
    a = q_monitor.q_checks(s, sf).withColumn("resolved", F.lit(False))
    SK.snk_append(a, base)
    return s.read.parquet(base).groupBy("alert_type", "resolved").agg(F.count("*").alias("n"))


reg("mon_alert_store", _alert_store,
    q_monitor.CHECKS_CTE + "\nSELECT alert_type, false AS resolved, count(*) AS n FROM checks GROUP BY 1",
    ["v_predictions"])

reg("mon_recommend", lambda s, sf: q_monitor.q_report(s, sf).select("model_name", "recommendations"),
    f"SELECT model_name, recommendations FROM ({q_monitor.REPORT_SQL})", ["v_predictions"])

# ------------------------------------------------------------- small joins


def _probs(s, sf):
    v = E.ens_weighted_vote(spark_view(s, sf, "v_votes"))
    return A.prj_prob_columns(v.select("text_id", F.col("ensemble_probabilities").alias("probabilities")),
                              VOTE_CLASSES).drop("probabilities")


reg("prj_prob_columns", _probs,
    f"""WITH {q_ensemble.SCORES_SQL}
    SELECT text_id, {', '.join(f"coalesce(sum(score) FILTER (WHERE prediction = {lit(c)}), 0.0) AS {A.prob_column_name(c)}"
                               for c in VOTE_CLASSES)} FROM scores GROUP BY text_id""",
    ["v_votes"], [A.prob_column_name(c) for c in VOTE_CLASSES])

reg("srt_probabilities",
    lambda s, sf: srt_probabilities(E.ens_weighted_vote(spark_view(s, sf, "v_votes")), id_col="text_id",
                                    map_col="ensemble_probabilities"),
    f"""WITH {q_ensemble.SCORES_SQL}
    SELECT text_id, prediction AS category, score AS probability,
           row_number() OVER (PARTITION BY text_id ORDER BY score DESC, prediction) AS rank FROM scores""",
    ["v_votes"], ["probability"])


def _lineage(s, sf):
    p = spark_view(s, sf, "v_predictions")
    l = AU.prj_lineage(F.col("input_text"), "user_input", F.col("ts"))
    return p.select("id", l["source_type"].alias("source_type"), l["data_hash"].alias("data_hash"),
                    F.size(l["transformations"]).alias("n_transformations"))


reg("prj_lineage", _lineage,
    "SELECT id, 'user_input' AS source_type, sha256(input_text) AS data_hash, 0 AS n_transformations FROM v_predictions",
    ["v_predictions"])


def _align(s, sf):
    r = spark_view(s, sf, "v_drift_ref").groupBy("label").agg(F.count("*").alias("ref_count"))
    c = spark_view(s, sf, "v_drift_cur").groupBy("label").agg(F.count("*").alias("cur_count"))
    return r.join(c, "label", "full_outer").na.fill(0, ["ref_count", "cur_count"])


reg("join_category_align", _align,
    """SELECT coalesce(r.label, c.label) AS label, coalesce(ref_count, 0) AS ref_count, coalesce(cur_count, 0) AS cur_count
       FROM (SELECT label, count(*) AS ref_count FROM v_drift_ref GROUP BY 1) r
       FULL OUTER JOIN (SELECT label, count(*) AS cur_count FROM v_drift_cur GROUP BY 1) c ON r.label = c.label""",
    ["v_drift_ref", "v_drift_cur"])
reg("set_category_union",
    lambda s, sf: spark_view(s, sf, "v_drift_ref").select("label").union(
        spark_view(s, sf, "v_drift_cur").select("label")).distinct(),
    "SELECT label FROM v_drift_ref UNION SELECT label FROM v_drift_cur", ["v_drift_ref", "v_drift_cur"])
reg("set_distinct_models", lambda s, sf: M.mon_active_models(spark_view(s, sf, "v_predictions")),
    q_monitor.ACTIVE_SQL, ["v_predictions"])


def _pred_text(s, sf):
    v = E.ens_weighted_vote(spark_view(s, sf, "v_votes")).select("text_id", "ensemble_prediction")
    t = spark_view(s, sf, "v_predictions").select(F.col("id").alias("text_id"), "input_text")
    return v.join(t, "text_id").select("text_id", "ensemble_prediction", F.length("input_text").alias("text_length"))


reg("join_pred_text", _pred_text,
    f"""WITH {q_ensemble.SCORES_SQL},
    v AS (SELECT text_id, arg_min(prediction, (-score, prediction)) AS ensemble_prediction FROM scores GROUP BY 1)
    SELECT v.text_id, ensemble_prediction, length(input_text) AS text_length FROM v JOIN v_predictions p ON p.id = v.text_id""",
    ["v_votes", "v_predictions"])


def _ab_interval(s, sf):
    from ticketscope.plans.q_versions import TESTS
    return V.join_ab_interval(spark_view(s, sf, "v_ab_log"), TESTS[0]).groupBy("arm").agg(F.count("*").alias("n"))


reg("join_ab_interval", _ab_interval,
    """SELECT CASE WHEN version_id = 'm0' THEN 'A' ELSE 'B' END AS arm, count(*) AS n FROM v_ab_log
       WHERE version_id IN ('m0', 'm1') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY 1""",
    ["v_ab_log"])


reg("join_vocab_lookup",
    lambda s, sf: FE.join_vocab_lookup(q_text._clean(s, sf), id_col="ticket_id", text_col="clean", num_words=10000),
    f"""WITH {q_text.CLEAN_SQL},
    w AS (SELECT ticket_id, unnest(list_filter(string_split(clean, ' '), lambda x: x <> '')) AS word FROM clean),
    top AS (SELECT word FROM (SELECT word, count(*) AS n FROM w GROUP BY 1) ORDER BY n DESC, word LIMIT 9998)
    SELECT c.ticket_id AS doc_id, count(w.word) AS tokens, count(w.word) - count(top.word) AS oov_tokens
    FROM clean c LEFT JOIN w USING (ticket_id) LEFT JOIN top USING (word) GROUP BY 1""", ["v_tickets"])


def _pre_post(s, sf):
    p = spark_view(s, sf, "v_predictions")
    t = p.select(F.max("ts")).scalar()
    return M._windowed_pair(p, t, 1, 25, 1)


reg("join_pre_post_window", _pre_post,
    q_monitor.DEGRADATION_SQL.split("\n{")[0].split("pair AS (")[0] + "pair AS (" +
    q_monitor.DEGRADATION_SQL.split("pair AS (")[1].split("GROUP BY model_name)")[0].replace(
        "SELECT model_name, any_value(t) AS ts,", "SELECT model_name,") + "GROUP BY model_name) SELECT * FROM pair",
    ["v_predictions"], ["cur_acc", "cur_conf", "cur_lat", "cur_err", "base_acc", "base_conf", "base_lat", "base_err"])


def _top_terms(s, sf):
    t = FE.txt_tfidf(q_text._clean(s, sf), id_col="ticket_id", text_col="clean", max_features=10000)
    return top_n_per_group(t.where(F.col("tfidf") > 0), "doc_id", [F.desc("tfidf"), F.desc("term")], 20).select(
        "doc_id", "term", "rank")


reg("win_top_terms_per_doc", _top_terms,
    f"""WITH {q_text.tfidf_sql(10000)},
    n AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)
    SELECT doc_id, term, rank FROM (SELECT doc_id, term,
           row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term DESC) AS rank FROM n WHERE tfidf > 0)
    WHERE rank <= 20""", ["v_tickets"])


def _top_class(s, sf):
    from ticketscope.operators.explain import ex_global_features
    t = spark_view(s, sf, "v_tickets").select("ticket_id", "category", T.txt_clean("customer_message").alias("clean"))
    return ex_global_features(t, id_col="ticket_id", text_col="clean", label_col="category").select("label", "term", "rank")


reg("win_top_features_per_class", _top_class,
    f"SELECT label, term, rank FROM ({q_text.GLOBAL_SQL})", ["v_tickets"])


def _importance(s, sf):
    from ticketscope.operators import ml as ML
    from ticketscope.operators.windows import srt_feature_importance
    m = ML.ml_train_pipeline(spark_view(s, sf, "v_tickets"), model_type="random_forest", max_features=10000)
    cv = next(st for st in m.stages if st.__class__.__name__ == "CountVectorizerModel")
    rf = next(st for st in m.stages if st.__class__.__name__ == "RandomForestClassificationModel")
    imp = rf.featureImportances.toArray()
    rows = [(w, float(imp[i])) for i, w in enumerate(cv.vocabulary)]
    return srt_feature_importance(s.createDataFrame(rows, "feature string, importance double"), n=10)


reg("srt_feature_importance", _importance)

# ------------------------------------------------------------ scalar fns

reg("fn_replace_vars",
    lambda s, sf: spark_view(s, sf, "v_response_req").select(
        "request_id", T.fn_replace_vars(F.lit("Dear {customer_name}, about {issue_type}: {missing}"),
                                        {"customer_name": F.col("customer_name"), "issue_type": F.col("category")}).alias("t")),
    "SELECT request_id, 'Dear ' || customer_name || ', about ' || category || ': {missing}' AS t FROM v_response_req",
    ["v_response_req"])


def _arrays(s, sf):
    sc = E.ens_class_scores(spark_view(s, sf, "v_votes"))
    return sc.groupBy("text_id").agg(F.collect_list("score").alias("p"))


reg("fn_entropy", lambda s, sf: _arrays(s, sf).select("text_id", T.fn_entropy(F.col("p")).alias("entropy")),
    f"""WITH {q_ensemble.SCORES_SQL},
    s AS (SELECT *, sum(score + 1e-10) OVER (PARTITION BY text_id) AS S FROM scores)
    SELECT text_id, -sum((score + 1e-10) / S * ln((score + 1e-10) / S)) AS entropy FROM s GROUP BY 1""",
    ["v_votes"], ["entropy"])
reg("fn_array_stats",
    lambda s, sf: _arrays(s, sf).select("text_id", T.fn_array_stats(F.col("p")).alias("st")).select("text_id", "st.*"),
    f"""WITH {q_ensemble.SCORES_SQL}
    SELECT text_id, max(score) AS max, avg(score) AS mean, var_pop(score) AS variance FROM scores GROUP BY 1""",
    ["v_votes"], ["max", "mean", "variance"])
reg("fn_map_access",
    lambda s, sf: spark_view(s, sf, "v_ab_log").select(
        "id", T.fn_map_access(F.col("metrics"), "latency_ms", -1.0).alias("lat"),
        T.fn_map_access(F.col("metrics"), "missing", -1.0).alias("missing")),
    "SELECT id, latency_ms AS lat, -1.0 AS missing FROM v_ab_log", ["v_ab_log"], ["lat", "missing"])
reg("fn_json",
    lambda s, sf: s.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_type").alias("t"))).alias("j")),
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"t":"' || event_type || '"}' AS j FROM events""")
reg("fn_safe_div",
    lambda s, sf: s.read.parquet(f"{sf}/events.parquet").select(
        "event_id", T.fn_safe_div(F.col("value"), F.get_json_object("props", "$.k").cast("double") % 7).alias("r")),
    "SELECT event_id, value / NULLIF(CAST(json_extract(props, '$.k') AS DOUBLE) % 7, 0) AS r FROM events", [], ["r"])


def _b64(s, sf):
    from ticketscope.sources.files import fn_base64
    e = s.read.parquet(f"{sf}/events.parquet")
    enc = F.concat(F.lit("data:application/json;base64,"), F.base64(F.encode("props", "UTF-8")))
    return e.select("event_id", F.decode(fn_base64(enc), "UTF-8").alias("props"))


reg("fn_base64", _b64, "SELECT event_id, props FROM events")

# ------------------------------------------------------------- text / drift


def _pruned(s, sf):
    t = spark_view(s, sf, "v_tickets")
    return FE.txt_tfidf_pruned(t, id_col="ticket_id", text_col="customer_message", max_features=10000,
                               ngram_range=(1, 3)).select("doc_id", "term", "tfidf")


def _pruned_sql():
    toks = (f"list_filter(regexp_extract_all(lower(t), {lit(T.TOKEN2_RE)}), "
            f"lambda x: NOT list_contains({q_text.STOP_SQL}, x))")
    return f"""WITH l AS (SELECT ticket_id, strip_accents({q_text.sq_light('customer_message')}) AS t FROM v_tickets),
    tk AS (SELECT ticket_id, {toks} AS toks FROM l),
    tf AS (SELECT ticket_id AS doc_id, term, count(*) AS tf FROM (SELECT ticket_id, unnest({q_text.GRAMS3_SQL}) AS term FROM tk) GROUP BY 1, 2),
    nd AS (SELECT count(*) AS n FROM v_tickets),
    vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1
              HAVING count(*) >= 2 AND count(*) <= floor((SELECT n FROM nd) * 0.95)
              ORDER BY total DESC, term LIMIT 10000),
    w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1 + n) / (1 + vocab.df)) + 1) AS w FROM tf JOIN vocab USING (term), nd)
    SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w"""


reg("txt_tfidf_pruned", _pruned, _pruned_sql(), ["v_tickets"], ["tfidf"])


def _assembled(s, sf):
    """Per ticket: entries of the assembled vector and its squared length after standardising."""
    from ticketscope.operators.assembly import ft_assemble_all
    t = spark_view(s, sf, "v_tickets").select("ticket_id", "customer_message")
    rows, _ = ft_assemble_all(t, id_col="ticket_id", text_col="customer_message")
    return rows.select(F.col("id").alias("ticket_id"), F.size("idx").alias("n_entries"),
                       (F.col("sq_norm") / 10000.0).alias("norm"))


def _scaler(s, sf):
    """Every assembled feature's group, number, mean and deviation."""
    from ticketscope.operators.assembly import fit_scaler, group_features
    t = spark_view(s, sf, "v_tickets").select("ticket_id", "customer_message")
    f = group_features(t, id_col="ticket_id", text_col="customer_message")
    return fit_scaler(f, t.count()).table


def _long_features_sql():
    names = [("statistical", FE.STAT_FEATURES, q_text.STAT_SQL), ("domain", FE.DOMAIN_FEATURES, q_text.DOMAIN_SQL),
             ("sentiment", ["sentiment_score", "positive_count", "neutral_count", "negative_count"], q_text.SENT_SQL)]
    dense = " UNION ALL ".join(f"SELECT ticket_id AS id, '{g}' AS grp, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {g}"
                               for g, cols, _ in names for c in cols)
    return (", ".join(f"{g} AS ({sql})" for g, _, sql in names)
            + f""", long AS (SELECT doc_id AS id, 'tfidf' AS grp, term AS feature, tfidf AS value FROM ({_pruned_sql()}) p
                             UNION ALL {dense}),
    present AS (SELECT * FROM long WHERE value <> 0),
    n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v_tickets),
    m AS (SELECT grp, feature, sum(value) / any_value(n) AS mean, sum(value * value) / any_value(n) AS sq FROM present, n GROUP BY 1, 2),
    sc AS (SELECT grp, feature, CAST(row_number() OVER (ORDER BY grp, feature) - 1 AS INTEGER) AS index, mean,
                  CASE WHEN sq - mean * mean > 1e-12 THEN sqrt(sq - mean * mean) ELSE 1.0 END AS std FROM m)""")


reg("ft_assemble_all", _assembled,
    f"""WITH {_long_features_sql()},
    off AS (SELECT sum((mean / std) * (mean / std)) AS o FROM sc),
    d AS (SELECT id, count(*) AS c, sum(value / std * (value / std) - 2 * value / std * mean / std) AS d
          FROM present JOIN sc USING (grp, feature) GROUP BY 1)
    SELECT t.ticket_id, CAST(coalesce(c, 0) AS INTEGER) AS n_entries, (coalesce(d, 0.0) + o) / 10000.0 AS norm
    FROM v_tickets t LEFT JOIN d ON d.id = t.ticket_id, off""", ["v_tickets"], ["norm"])
reg("ft_assemble_scaler", _scaler, f"WITH {_long_features_sql()} SELECT * FROM sc", ["v_tickets"], ["mean", "std"])


def _fit_reference(s, sf):
    base = _fresh(s, "ref")
    ref = spark_view(s, sf, "v_drift_ref")
    SK.save_state(A.agg_text_ref_stats(ref, "text"), base)
    return SK.load_state(s, base)


reg("drift_fit_reference", _fit_reference,
    """SELECT avg(length(text)) AS avg_length,
        avg(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS avg_word_count,
        (SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+')) AS w
           FROM v_drift_ref) WHERE w <> '') AS vocab_size FROM v_drift_ref""", ["v_drift_ref"],
    ["avg_length", "avg_word_count"])


def _text_samples(s, sf):
    """Tickets of the first half of the month and of the second."""
    t = spark_view(s, sf, "v_tickets").select("ticket_id", "customer_message", "category", "ts")
    split = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return t.where(F.col("ts") < split), t.where(F.col("ts") >= split)


def _fit_text_reference(s, sf):
    from ticketscope.operators.text_drift import TextReference, fit_reference
    base = _fresh(s, "text_ref")
    ref, _ = _text_samples(s, sf)
    fitted, stats, texts = fit_reference(ref, id_col="ticket_id", text_col="customer_message", label_col="category")
    fitted.save(s, f"{base}/features")
    SK.save_state(stats, f"{base}/stats")
    n = TextReference.load(s, f"{base}/features").vocabulary.count()
    return SK.load_state(s, f"{base}/stats").withColumn("n_terms", F.lit(n))


reg("drift_fit_text_reference", _fit_text_reference)


def _text_report(s, sf):
    """Six methods over the components of the reference's TF-IDF."""
    from ticketscope.operators.text_drift import fit_text_reference, text_features
    ref, cur = _text_samples(s, sf)
    fitted = fit_text_reference(ref, id_col="ticket_id", text_col="customer_message")
    k = len(fitted.pca.variance)
    names = [f"f{i:03d}" for i in range(k)]

    def wide(df):
        x = text_features(df, fitted, id_col="ticket_id", text_col="customer_message")
        cols = [F.col("features")[i].alias(n) for i, n in enumerate(names)]
        return materialize(x.join(df.select(F.col("ticket_id").alias("id"), F.col("category").alias("label")), "id").select(
            "id", "label", *cols))

    return D.drift_report(wide(ref), wide(cur), names)


reg("drift_text_report", _text_report)


def _recommend(s, sf):
    r = q_drift._report("v_drift_cur_shift")(s, sf)
    return D.drift_recommend(r).select(F.array_join("recommendations", " | ").alias("recommendations"))


reg("drift_recommend", _recommend,
    f"""WITH rep AS ({q_drift.report_sql('v_drift_cur_shift')}),
    g AS (SELECT max(CASE WHEN method = 'psi' THEN score END) AS psi, count(*) FILTER (WHERE drift_detected) AS n,
                 bool_or(drift_detected) FILTER (WHERE method = 'covariate_shift') AS cov FROM rep)
    SELECT concat_ws(' | ',
      CASE WHEN psi > 0.2 THEN 'Major distribution shift detected - immediate model retraining recommended'
           WHEN psi > 0.1 THEN 'Moderate distribution shift - monitor closely and consider retraining' END,
      CASE WHEN cov THEN 'Covariate shift detected - review feature engineering and data sources' END,
      CASE WHEN n >= 3 THEN 'Multiple drift indicators - comprehensive model review needed'
           WHEN n >= 2 THEN 'Some drift indicators present - increase monitoring frequency' END) AS recommendations FROM g""",
    ["v_drift_ref", "v_drift_cur_shift"])


def _alert(s, sf):
    a = D.drift_assess(q_drift._report("v_drift_cur_shift")(s, sf))
    return a.where("overall_drift_detected").select(F.lit("data_drift").alias("alert_type"), "severity", "drift_score")


reg("drift_alert", _alert,
    f"""WITH rep AS ({q_drift.report_sql('v_drift_cur_shift')}),
    a AS (SELECT avg(CAST(drift_detected AS INTEGER)) AS drift_score FROM rep)
    SELECT 'data_drift' AS alert_type, CASE WHEN drift_score > 0.7 THEN 'high' ELSE 'medium' END AS severity, drift_score
    FROM a WHERE drift_score > 0.5""", ["v_drift_ref", "v_drift_cur_shift"], ["drift_score"])


def _drift_hist(s, sf):
    p = spark_view(s, sf, "v_predictions")
    daily = p.groupBy(F.to_date("ts").alias("d")).agg(
        F.avg((F.col("confidence") < 0.7).cast("int")).alias("drift_score"))
    reps = daily.select(F.col("d").cast("timestamp_ntz").alias("ts"), "drift_score",
                        (F.col("drift_score") > 0.5).alias("overall_drift_detected"))
    s7 = D.drift_summary(reps)
    return s7.select("avg_drift_score", "drift_detections", "total_checks", F.col("latest.ts").alias("latest_ts"))


reg("drift_history", _drift_hist,
    """WITH r AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, avg(CAST(confidence < 0.7 AS INTEGER)) AS drift_score
                  FROM v_predictions GROUP BY 1),
    h AS (SELECT * FROM r WHERE ts > (SELECT max(ts) FROM r) - INTERVAL 7 DAY)
    SELECT avg(drift_score) AS avg_drift_score, count(*) FILTER (WHERE drift_score > 0.5) AS drift_detections,
           count(*) AS total_checks, max(ts) AS latest_ts FROM h""", ["v_predictions"], ["avg_drift_score"])

# ------------------------------------------------------------ audit / misc


def _gdpr_delete(s, sf):
    remaining, counts = AU.aud_gdpr_delete(spark_view(s, sf, "v_audit"), spark_view(s, sf, "v_gdpr"))
    return counts


reg("aud_gdpr_delete", _gdpr_delete,
    f"""WITH {q_audit.IDS_SQL},
    m AS (SELECT request_id, count(*) AS n FROM ids JOIN v_audit a ON a.user_id = ids.identity GROUP BY 1)
    SELECT g.request_id, coalesce(m.n, 0) AS deleted_records FROM v_gdpr g LEFT JOIN m USING (request_id)
    WHERE g.request_type = 'deletion'""", ["v_audit", "v_gdpr"])
reg("aud_gdpr_create",
    lambda s, sf: AU.aud_gdpr_create_batch(spark_view(s, sf, "v_gdpr").drop("request_id", "status")).select(
        "request_type", "user_id", "status"),
    "SELECT request_type, user_id, 'pending' AS status FROM v_gdpr", ["v_gdpr"])

reg("al_select", lambda s, sf: E.al_select(E.al_uncertainty(spark_view(s, sf, "v_votes"))),
    f"SELECT *, combined_uncertainty AS uncertainty_score, true AS needs_review FROM ({q_ensemble.UNC_SQL}) u "
    "WHERE combined_uncertainty > 0.5", ["v_votes"],
    ["entropy", "max_probability", "prediction_variance", "disagreement", "combined_uncertainty", "uncertainty_score"])


def _model_info(s, sf):
    base = _fresh(s, "info")
    r = spark_view(s, sf, "v_registry").groupBy("model_name").agg(
        F.max(F.col("performance_metrics")["accuracy"]).alias("test_accuracy"), F.count("*").alias("training_samples"))
    r = r.withColumn("model_type", F.when(F.col("training_samples") % 2 == 0, F.lit("random_forest")))
    r.write.json(base)
    return V.ver_model_info(s, base)


reg("ver_model_info", _model_info,
    """WITH r AS (SELECT model_name, max(accuracy) AS test_accuracy, count(*) AS training_samples FROM v_registry GROUP BY 1)
    SELECT model_name, CASE WHEN training_samples % 2 = 0 THEN 'random_forest' ELSE 'N/A' END AS model_type,
           format('{:,.4f}', test_accuracy) AS test_accuracy, 'N/A' AS num_classes,
           CAST(training_samples AS VARCHAR) AS training_samples FROM r""", ["v_registry"])


def _custom_templates(s, sf):
    req = spark_view(s, sf, "v_response_req")
    custom = req.select(F.lower("category").alias("category"), F.lit("high").alias("urgency")).distinct().select(
        "category", "urgency", F.concat(F.lit("Hello {customer_name}, your "), F.col("category"),
                                        F.lit(" ticket is top priority.")).alias("template"),
        F.lit(None).cast("string").alias("tone"))
    t = R.templates_df(s, custom)
    return R.rsp_template(req, t).select("request_id", "response_text", "template_used", "template_tone")


reg("rsp_custom_templates", _custom_templates,
    f"""WITH {[q for q in __import__('ticketscope.plans.q_responses', fromlist=['Q']).Q if q.name == 'rsp_template'][0].sql
              .split('rendered AS (')[0].replace('WITH ', '', 1).rstrip().rstrip(',')},
    custom AS (SELECT DISTINCT lower(category) || '_high' AS key,
                      'Hello {{customer_name}}, your ' || lower(category) || ' ticket is top priority.' AS template,
                      'professional' AS tone FROM v_response_req),
    t AS (SELECT * FROM tpl WHERE key NOT IN (SELECT key FROM custom) UNION ALL SELECT * FROM custom)
    SELECT q.request_id,
      replace(coalesce(t1.template, t2.template, (SELECT template FROM t WHERE key = 'general_medium')),
              '{{customer_name}}', q.customer_name) AS response_text,
      CASE WHEN t1.template IS NOT NULL THEN lower(category) || '_' || lower(urgency)
           WHEN t2.template IS NOT NULL THEN 'general_' || lower(urgency) ELSE 'general_medium' END AS template_used,
      coalesce(t1.tone, t2.tone, (SELECT tone FROM t WHERE key = 'general_medium')) AS template_tone
    FROM v_response_req q LEFT JOIN t t1 ON t1.key = lower(category) || '_' || lower(urgency)
    LEFT JOIN t t2 ON t2.key = 'general_' || lower(urgency)""", ["v_response_req"])

QUERIES = Q
