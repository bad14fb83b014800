"""ML queries: evaluation (oracle-checked), Pareto selection (oracle-checked),
and model training / scoring / tuning / topic / PCA / clustering (rows-only)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ticketscope.operators import ml as ML
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query
from ticketscope.session import materialize
from ticketscope.streaming.jobs import scratch

Q = []
OBJ = ["obj1", "obj2", "obj3"]


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def _fb(s, sf):
    return spark_view(s, sf, "v_feedback")


reg("ev_accuracy", lambda s, sf: ML.ev_accuracy(_fb(s, sf)),
    "SELECT avg(CAST(true_category = predicted_category AS INTEGER)) AS accuracy, count(*) AS n FROM v_feedback",
    ["v_feedback"], ["accuracy"])
reg("ev_confusion", lambda s, sf: ML.ev_confusion(_fb(s, sf)),
    "SELECT true_category AS actual, predicted_category AS predicted, count(*) AS count FROM v_feedback GROUP BY 1, 2",
    ["v_feedback"])
reg("ev_class_report", lambda s, sf: ML.ev_class_report(_fb(s, sf)),
    """WITH sup AS (SELECT true_category AS class, count(*) AS support FROM v_feedback GROUP BY 1),
    pc AS (SELECT predicted_category AS class, count(*) AS predicted FROM v_feedback GROUP BY 1),
    tp AS (SELECT true_category AS class, count(*) AS tp FROM v_feedback WHERE true_category = predicted_category GROUP BY 1),
    j AS (SELECT coalesce(sup.class, pc.class) AS class, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
                 coalesce(tp, 0) AS tp
          FROM sup FULL OUTER JOIN pc ON sup.class = pc.class LEFT JOIN tp ON tp.class = coalesce(sup.class, pc.class)),
    m AS (SELECT class, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0.0) AS precision,
                 coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS recall, support FROM j),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
          FROM m WHERE support > 0)
    SELECT class, precision, recall, support, f1 FROM f
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), sum(support), avg(f1) FROM f
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                     sum(support), sum(f1 * support) / sum(support) FROM f""",
    ["v_feedback"], ["precision", "recall", "f1"])

PARETO_SQL = """SELECT * FROM v_trials a WHERE NOT EXISTS (
  SELECT 1 FROM v_trials b WHERE b.obj1 >= a.obj1 AND b.obj2 >= a.obj2 AND b.obj3 >= a.obj3
    AND (b.obj1 > a.obj1 OR b.obj2 > a.obj2 OR b.obj3 > a.obj3))"""

reg("join_pareto_dominance", lambda s, sf: ML.join_pareto_dominance(spark_view(s, sf, "v_trials"), OBJ),
    PARETO_SQL, ["v_trials"], OBJ)
reg("tune_pareto",
    lambda s, sf: ML.tune_pareto(ML.join_pareto_dominance(spark_view(s, sf, "v_trials"), OBJ), OBJ),
    f"""SELECT *, obj1 * 0.5 + obj2 * 0.3 + obj3 * 0.2 AS weighted_score FROM ({PARETO_SQL})
        ORDER BY weighted_score DESC, trial LIMIT 1""", ["v_trials"], OBJ + ["weighted_score"])


def _history(s, sf):
    t = spark_view(s, sf, "v_trials")
    return t.select("model_type", F.lit("grid_search").alias("method"), F.col("trial").cast("string").alias("params"),
                    F.col("obj1").alias("score"),
                    F.timestamp_add("MINUTE", F.col("trial"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))


HIST_SQL = """h AS (SELECT model_type, 'grid_search' AS method, CAST(trial AS VARCHAR) AS params, obj1 AS score,
                          TIMESTAMP '2024-01-01' + to_minutes(trial) AS ts FROM v_trials)"""
reg("tune_best", lambda s, sf: ML.tune_best(_history(s, sf)),
    f"""WITH {HIST_SQL} SELECT model_type, method, params, score, ts FROM (SELECT *, row_number() OVER
        (PARTITION BY model_type ORDER BY score DESC, ts) AS r FROM h) WHERE r = 1""", ["v_trials"], ["score"])
reg("tune_compare", lambda s, sf: ML.tune_compare(_history(s, sf)),
    f"""WITH {HIST_SQL} SELECT model_type, method, max(score) AS best_score, count(*) AS n_trials, max(ts) AS ts
        FROM h GROUP BY 1, 2""", ["v_trials"], ["best_score"])


# ---------------------------------------------------------------- rows-only

def _tickets(s, sf):
    return spark_view(s, sf, "v_tickets")


def _model(s, sf, kind, **kw):
    return ML.ml_train_pipeline(_tickets(s, sf), model_type=kind, max_features=kw.pop("max_features", 10000), **kw)


def _scored(kind, **kw):
    def run(s, sf):
        m = _model(s, sf, kind, **kw)
        p = ML.ml_predict_batch(m, _tickets(s, sf), with_prob_columns=False)
        return p.select("ticket_id", "category", "predicted_category", "confidence")
    return run


reg("ml_logistic_regression", _scored("logistic_regression"))
reg("ml_random_forest", _scored("random_forest"))
reg("ml_linear_svm", lambda s, sf: ML.ml_predict_batch(_model(s, sf, "linear_svm"), _tickets(s, sf),
                                                       with_prob_columns=False).select("ticket_id", "predicted_category"))


def _predict_batch(s, sf):
    m = _model(s, sf, "logistic_regression")
    p = ML.ml_predict_batch(m, _tickets(s, sf))
    return p.drop("probabilities", "customer_message")


reg("ml_predict_batch", _predict_batch)


def _train_job(s, sf):
    """Split, fit, evaluation on the test part, saved model and record."""
    return ML.ml_train_job(_tickets(s, sf), scratch(s, f"io-train-{uuid.uuid4().hex}"), id_col="ticket_id",
                           model_type="logistic_regression").select("accuracy", "n")


reg("ml_train_pipeline", _train_job)


def _cv(s, sf):
    # the vectors that the pipeline was fitted on: texts are cleaned and counted once
    _, prepared = ML.ml_train_vectors(_tickets(s, sf), model_type="logistic_regression", max_features=10000)
    grid = [{"C": 0.1, "max_iter": 100}, {"C": 1, "max_iter": 100}, {"C": 10, "max_iter": 100}]
    return ML.tune_cross_validate(prepared, "logistic_regression", grid, folds=3)


reg("tune_cross_validate", _cv)


def _covariate(s, sf):
    from ticketscope.operators.drift import drift_covariate_shift
    return drift_covariate_shift(spark_view(s, sf, "v_drift_ref"), spark_view(s, sf, "v_drift_cur_shift"),
                                 ["value", "k"])


reg("drift_covariate_shift", _covariate)


def _topics(s, sf):
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array
    from ticketscope.functions.text import txt_clean
    from ticketscope.operators.features import ft_topics, tokens_expr
    t = _tickets(s, sf).select(F.col("ticket_id").alias("doc_id"),
                               tokens_expr(txt_clean("customer_message")).alias("toks"))
    n = t.count()  # as a number of documents the bound needs no kept copy of all tokens
    most = 0.95 * n if 0.95 * n >= 1 else 0.95
    vec = CountVectorizer(inputCol="toks", outputCol="features", vocabSize=5000, minDF=2.0, maxDF=most).fit(t).transform(t)
    vec = materialize(vec.select("doc_id", "features"))  # read again by every iteration
    r = ft_topics(vec, k=20, max_iter=20)
    arr = vector_to_array("topic_distribution")
    return r.select("doc_id", (F.array_position(arr, F.array_max(arr)) - 1).alias("dominant_topic"),
                    F.array_max(arr).alias("weight"))


reg("ft_topics", _topics)


def _pca(s, sf):
    """TF-IDF of 5,000 terms to 100 components."""
    from ticketscope.operators.text_drift import fit_text_reference, text_features
    t = _tickets(s, sf).select("ticket_id", "customer_message")
    fitted = fit_text_reference(t, id_col="ticket_id", text_col="customer_message", max_features=5000, k=100)
    return text_features(t, fitted, id_col="ticket_id", text_col="customer_message").select(
        F.col("id").alias("ticket_id"), F.col("features").alias("pc"))


reg("ft_pca", _pca)


def _scale(s, sf):
    from pyspark.ml.functions import vector_to_array
    from ticketscope.operators.features import STAT_FEATURES, ft_assemble_scale, ft_statistical
    f = ft_statistical(_tickets(s, sf).select("ticket_id", "customer_message"), "customer_message")
    out = ft_assemble_scale(f, STAT_FEATURES)
    return out.select("ticket_id", *[F.col(f"z_{c}") for c in STAT_FEATURES])


def _scale_sql():
    from ticketscope.operators.features import STAT_FEATURES
    from ticketscope.plans.q_text import STAT_SQL
    z = ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 "
                  f"ELSE stddev_pop({c}) OVER () END AS z_{c}" for c in STAT_FEATURES)
    return f"SELECT ticket_id, {z} FROM ({STAT_SQL}) f"


def _scale_dbl():
    from ticketscope.operators.features import STAT_FEATURES
    return [f"z_{c}" for c in STAT_FEATURES]


reg("ft_assemble_scale", _scale, _scale_sql(), ["v_tickets"], _scale_dbl())


def _diverse(s, sf):
    from ticketscope.operators.ensemble import al_select, al_uncertainty
    from ticketscope.operators.learning import al_diverse
    u = al_select(al_uncertainty(spark_view(s, sf, "v_votes")))
    p = spark_view(s, sf, "v_predictions").select(F.col("id").alias("text_id"), F.col("input_text").alias("text"),
                                                  "confidence")
    cand = u.select("text_id", "uncertainty_score").join(p, "text_id")
    return al_diverse(cand, max_samples=20)


reg("al_diverse", _diverse)


def _counterfactual(s, sf):
    from ticketscope.operators.counterfactual import ex_counterfactual_linear
    from ticketscope.operators.explain import CLASS_LEXICON
    m = _model(s, sf, "logistic_regression")
    labels = ML.model_labels(m)
    # every second ticket asks for a class, the others for the second most likely one
    goal = F.when(F.col("ticket_id") % 2 == 1, F.element_at(F.array(*[F.lit(c) for c in labels]),
                                                            (F.col("ticket_id") % len(labels) + 1).cast("int")))
    t = _tickets(s, sf).select("ticket_id", "customer_message", goal.alias("target"))
    lexicon = CLASS_LEXICON | {c: ([c, *CLASS_LEXICON["General Inquiry"][0]], CLASS_LEXICON["General Inquiry"][1])
                               for c in labels if c not in CLASS_LEXICON}
    out = ex_counterfactual_linear(t, m, id_col="ticket_id", text_col="customer_message", target_col="target",
                                   lexicon=lexicon)
    return out.select("ticket_id", "original_class", "original_confidence", "target_class", "success_rate",
                      F.size("counterfactuals").alias("n_counterfactuals"),
                      F.to_json("counterfactuals").alias("counterfactuals"))


reg("ex_counterfactual", _counterfactual)


def _surrogate(s, sf):
    from ticketscope.operators.counterfactual import LinearText
    from ticketscope.operators.explain import ex_local_surrogate
    m = _model(s, sf, "logistic_regression")
    toks = ML.model_tokens(m, _tickets(s, sf).select("ticket_id", "customer_message"), text_col="customer_message")
    scorer = ML.token_stages(m)
    return ex_local_surrogate(toks, LinearText.of(scorer), id_col="ticket_id", tokens_col="_tok2", n_samples=500)


reg("ex_local_surrogate", _surrogate)

QUERIES = Q
