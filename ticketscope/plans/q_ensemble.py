"""Ensemble voting and active-learning uncertainty over v_votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketscope.operators import ensemble as E
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query

Q = []


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def _votes(s, sf):
    return spark_view(s, sf, "v_votes")


def _history(s, sf):
    """Evaluation history per model: daily accuracy of the vote fixture against
    the event type, derived from events (model, ts, accuracy, confidence)."""
    v = _votes(s, sf)
    e = spark_view(s, sf, "v_predictions").select(F.col("id").alias("text_id"), F.to_date("ts").alias("d"),
                                                  F.col("predicted_class").alias("truth"))
    j = v.join(e, "text_id")
    return j.groupBy("model", "d").agg(
        F.avg((F.col("prediction") == F.col("truth")).cast("int")).alias("accuracy"),
        F.avg("confidence").alias("confidence")).select(
        "model", F.col("d").cast("timestamp_ntz").alias("ts"), "accuracy", "confidence")


SCORES_SQL = """scores AS (
  SELECT text_id, prediction, sum(wn) AS score, count(*) AS n_votes FROM (
    SELECT text_id, prediction, w / sum(w) OVER (PARTITION BY text_id) AS wn FROM (
      SELECT text_id, prediction, confidence * (1 + 0.5) AS w FROM v_votes))
  GROUP BY text_id, prediction)"""

VOTE_SQL = f"""WITH {SCORES_SQL}
SELECT text_id, arg_min(prediction, (-score, prediction)) AS ensemble_prediction,
       max(score) AS ensemble_confidence,
       CASE WHEN sum(n_votes) <= 1 THEN 1.0 ELSE CAST(max(n_votes) AS DOUBLE) / sum(n_votes) END AS agreement_score,
       max(score) > 0.7 AS high_confidence
FROM scores GROUP BY text_id"""


def _vote(s, sf):
    return E.ens_weighted_vote(_votes(s, sf)).select("text_id", "ensemble_prediction", "ensemble_confidence",
                                                     "agreement_score", "high_confidence")


reg("ens_weighted_vote", _vote, VOTE_SQL, ["v_votes"], ["ensemble_confidence", "agreement_score"])

reg("ens_agreement", lambda s, sf: E.ens_agreement(_votes(s, sf)),
    """SELECT text_id, CASE WHEN sum(n) <= 1 THEN 1.0 ELSE CAST(max(n) AS DOUBLE) / sum(n) END AS agreement_score
       FROM (SELECT text_id, prediction, count(*) AS n FROM v_votes GROUP BY 1, 2) GROUP BY text_id""",
    ["v_votes"], ["agreement_score"])

reg("ens_batch",
    lambda s, sf: E.ens_batch(_votes(s, sf).where(F.col("text_id") % 7 != 0),
                              spark_view(s, sf, "v_predictions").select(F.col("id").alias("text_id"))),
    f"""WITH {SCORES_SQL.replace("FROM v_votes", "FROM v_votes WHERE text_id % 7 <> 0")},
    r AS (SELECT text_id, arg_min(prediction, (-score, prediction)) AS ensemble_prediction,
                 max(score) AS ensemble_confidence,
                 CASE WHEN sum(n_votes) <= 1 THEN 1.0 ELSE CAST(max(n_votes) AS DOUBLE) / sum(n_votes) END AS agreement_score,
                 max(score) > 0.7 AS high_confidence FROM scores GROUP BY text_id)
    SELECT p.id AS text_id, coalesce(ensemble_prediction, 'Error') AS ensemble_prediction,
           coalesce(ensemble_confidence, 0.0) AS ensemble_confidence, coalesce(agreement_score, 0.0) AS agreement_score,
           coalesce(high_confidence, false) AS high_confidence
    FROM v_predictions p LEFT JOIN r ON r.text_id = p.id""",
    ["v_votes", "v_predictions"], ["ensemble_confidence", "agreement_score"])


def _evaluate(s, sf):
    res = E.ens_weighted_vote(_votes(s, sf))
    labels = spark_view(s, sf, "v_predictions").select(F.col("id").alias("text_id"),
                                                       F.col("predicted_class").alias("true_label"))
    return E.ens_evaluate(res, labels)


reg("ens_evaluate", _evaluate,
    f"""{VOTE_SQL.replace("SELECT text_id, arg_min", ", r AS (SELECT text_id, arg_min", 1).replace(
        "WITH scores", "WITH scores", 1)}
    """.replace("FROM scores GROUP BY text_id", "FROM scores GROUP BY text_id)") + """
    SELECT avg(CAST(ensemble_prediction = p.predicted_class AS INTEGER)) AS accuracy,
           avg(ensemble_confidence) AS average_confidence,
           coalesce(avg(CASE WHEN ensemble_confidence > 0.7 THEN CAST(ensemble_prediction = p.predicted_class AS INTEGER) END), 0.0)
             AS high_confidence_accuracy,
           count(*) FILTER (WHERE ensemble_confidence > 0.7) AS high_confidence_samples
    FROM r JOIN v_predictions p ON p.id = r.text_id""",
    ["v_votes", "v_predictions"], ["accuracy", "average_confidence", "high_confidence_accuracy"])


def _class_report(s, sf):
    labels = spark_view(s, sf, "v_predictions").select(F.col("id").alias("text_id"), F.col("predicted_class").alias("true_label"))
    return E.ens_class_report(E.ens_weighted_vote(_votes(s, sf)), labels)


reg("ens_class_report", _class_report,
    f"""{VOTE_SQL.replace("SELECT text_id, arg_min", ", r AS (SELECT text_id, arg_min", 1)}
    """.replace("FROM scores GROUP BY text_id", "FROM scores GROUP BY text_id)") + """,
    j AS (SELECT p.predicted_class AS a, r.ensemble_prediction AS b FROM r JOIN v_predictions p ON p.id = r.text_id),
    c AS (SELECT a AS class, count(*) AS support, count(*) FILTER (WHERE a = b) AS tp FROM j GROUP BY 1),
    f AS (SELECT class, support, CAST(tp AS DOUBLE) / support AS recall,
                 coalesce(CAST(tp AS DOUBLE) / (SELECT nullif(count(*), 0) FROM j WHERE j.b = c.class), 0.0) AS precision FROM c),
    s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM f)
    SELECT class, precision, recall, support, f1 FROM s
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), CAST(sum(support) AS BIGINT), avg(f1) FROM s
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                     CAST(sum(support) AS BIGINT), sum(f1 * support) / sum(support) FROM s""",
    ["v_votes", "v_predictions"], ["precision", "recall", "f1"])

HIST_SQL = """hist AS (
  SELECT model, CAST(d AS TIMESTAMP) AS ts, avg(CAST(prediction = truth AS INTEGER)) AS accuracy,
         avg(confidence) AS confidence
  FROM (SELECT v.model, v.prediction, v.confidence, CAST(p.ts AS DATE) AS d, p.predicted_class AS truth
        FROM v_votes v JOIN v_predictions p ON p.id = v.text_id)
  GROUP BY model, d),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC) AS rn FROM hist) WHERE rn <= 3)"""

reg("win_model_rankings", lambda s, sf: E.win_model_rankings(_history(s, sf)),
    f"""WITH {HIST_SQL},
    g AS (SELECT model, avg(accuracy) AS average_accuracy, avg(confidence) AS average_confidence FROM recent GROUP BY 1),
    t AS (SELECT model, count(*) AS evaluations FROM hist GROUP BY 1)
    SELECT g.model, average_accuracy, average_confidence, evaluations,
           average_accuracy * 0.7 + average_confidence * 0.3 AS score,
           dense_rank() OVER (ORDER BY average_accuracy * 0.7 + average_confidence * 0.3 DESC) AS rank
    FROM g JOIN t USING (model)""", ["v_votes", "v_predictions"],
    ["average_accuracy", "average_confidence", "score"])

reg("win_recent_n",
    lambda s, sf: E.snk_append_model_history(_history(s, sf).where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")),
                                             _history(s, sf).where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))),
    f"""WITH {HIST_SQL}
    SELECT model, ts, accuracy, confidence FROM
      (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC) AS rn FROM hist) WHERE rn <= 10""",
    ["v_votes", "v_predictions"], ["accuracy", "confidence"])

reg("ens_history_weighted_vote",
    lambda s, sf: E.ens_weighted_vote(_votes(s, sf), _history(s, sf)).select(
        "text_id", "ensemble_prediction", "ensemble_confidence"),
    f"""WITH {HIST_SQL},
    hw AS (SELECT model, avg(accuracy) AS hist_accuracy FROM recent GROUP BY 1),
    sc AS (SELECT text_id, prediction, sum(wn) AS score FROM (
      SELECT text_id, prediction, w / sum(w) OVER (PARTITION BY text_id) AS wn FROM (
        SELECT v.text_id, v.prediction, v.confidence * (1 + coalesce(hw.hist_accuracy, 0.5)) AS w
        FROM v_votes v LEFT JOIN hw USING (model))) GROUP BY 1, 2)
    SELECT text_id, arg_min(prediction, (-score, prediction)) AS ensemble_prediction, max(score) AS ensemble_confidence
    FROM sc GROUP BY text_id""", ["v_votes", "v_predictions"], ["ensemble_confidence"])

UNC_SQL = f"""WITH {SCORES_SQL},
s AS (SELECT *, sum(score + 1e-10) OVER (PARTITION BY text_id) AS S,
             sum(n_votes) OVER (PARTITION BY text_id) AS m FROM scores),
g AS (SELECT text_id, -sum((score + 1e-10) / S * ln((score + 1e-10) / S)) AS entropy,
             max(score) AS max_probability,
             CASE WHEN any_value(m) > 1 THEN avg((CAST(n_votes AS DOUBLE) / m) * (1 - CAST(n_votes AS DOUBLE) / m)) ELSE 0.0 END
               AS prediction_variance,
             1 - CASE WHEN any_value(m) > 1 THEN CAST(max(n_votes) AS DOUBLE) / any_value(m) ELSE 1.0 END AS disagreement
      FROM s GROUP BY text_id)
SELECT *, entropy * 0.4 + (1 - max_probability) * 0.3 + prediction_variance * 0.3 AS combined_uncertainty FROM g"""

UNC_DBL = ["entropy", "max_probability", "prediction_variance", "disagreement", "combined_uncertainty"]
reg("al_uncertainty", lambda s, sf: E.al_uncertainty(_votes(s, sf)), UNC_SQL, ["v_votes"], UNC_DBL)

for strat, cond in [("combined", "combined_uncertainty > 0.5"), ("entropy", f"entropy > ln(7) * 0.7"),
                    ("confidence", "max_probability < 0.8"), ("disagreement", "disagreement > 0.3")]:
    score = {"combined": "combined_uncertainty", "entropy": "entropy", "confidence": "1 - max_probability",
             "disagreement": "disagreement"}[strat]
    reg(f"al_select_{strat}",
        (lambda st: lambda s, sf: E.al_select(E.al_uncertainty(_votes(s, sf)), strategy=st))(strat),
        f"SELECT *, {score} AS uncertainty_score, true AS needs_review FROM ({UNC_SQL}) u WHERE {cond}",
        ["v_votes"], UNC_DBL + ["uncertainty_score"])

QUERIES = Q
