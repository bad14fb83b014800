"""Feedback, active-learning and online-learner queries over v_feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketscope.operators import learning as L
from ticketscope.plans.fixtures import spark_view
from ticketscope.plans.registry import Query

Q = []
ASOF = "(SELECT max(ts) FROM events)"


def reg(name, fn, sql=None, views=(), dbl=()):
    Q.append(Query(name, fn, sql, list(views), tuple(dbl)))


def _fb(s, sf):
    return spark_view(s, sf, "v_feedback")


reg("al_record_feedback",
    lambda s, sf: L.al_record_feedback(_fb(s, sf)).select("id", "was_correct", "error_pattern"),
    """SELECT id, predicted_category = true_category AS was_correct,
       CASE WHEN predicted_category <> true_category THEN predicted_category || ' -> ' || true_category END
         AS error_pattern FROM v_feedback""", ["v_feedback"])

reg("al_feedback_accuracy", lambda s, sf: L.al_feedback_accuracy(_fb(s, sf)),
    """SELECT coalesce(avg(CAST(predicted_category = true_category AS INTEGER)), 0.0) AS feedback_accuracy,
              count(*) AS total_feedback FROM v_feedback""", ["v_feedback"], ["feedback_accuracy"])


def _patterns(s, sf):
    p = L.al_error_patterns(_fb(s, sf))
    return p.select("pattern", "predicted_category", "true_category", "count", "avg_confidence",
                    "recent_occurrences", "overconfident", F.array_join("sample_texts", "||").alias("sample_texts"))


reg("al_error_patterns", _patterns,
    f"""WITH err AS (SELECT *, predicted_category || ' -> ' || true_category AS pattern FROM v_feedback
                     WHERE predicted_category <> true_category),
    g AS (SELECT pattern, predicted_category, true_category, count(*) AS count, avg(confidence) AS avg_confidence,
                 count(*) FILTER (WHERE floor((epoch_us({ASOF}) - epoch_us(ts)) / 86400000000) <= 7) AS recent_occurrences
          FROM err GROUP BY ALL),
    smp AS (SELECT pattern, string_agg(t, '||' ORDER BY r) AS sample_texts FROM (
              SELECT pattern, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS t,
                     row_number() OVER (PARTITION BY pattern ORDER BY ts, id) AS r FROM err) WHERE r <= 5 GROUP BY 1)
    SELECT g.*, avg_confidence > 0.8 AS overconfident, smp.sample_texts FROM g JOIN smp USING (pattern)""",
    ["v_feedback"], ["avg_confidence"])

reg("win_error_samples",
    lambda s, sf: L.al_error_patterns(_fb(s, sf)).select("pattern", F.size("sample_texts").alias("n_samples"),
                                                        F.element_at("sample_texts", 1).alias("first_sample")),
    """WITH err AS (SELECT *, predicted_category || ' -> ' || true_category AS pattern FROM v_feedback
                    WHERE predicted_category <> true_category),
    r AS (SELECT pattern, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS t,
                 row_number() OVER (PARTITION BY pattern ORDER BY ts, id) AS r FROM err)
    SELECT pattern, count(*) AS n_samples, max(CASE WHEN r = 1 THEN t END) AS first_sample FROM r WHERE r <= 5
    GROUP BY pattern""", ["v_feedback"])

reg("al_retrain_strategy", lambda s, sf: L.al_retrain_strategy(_fb(s, sf)),
    """WITH pat AS (SELECT predicted_category, true_category, count(*) AS c FROM v_feedback
                    WHERE predicted_category <> true_category GROUP BY 1, 2),
    top AS (SELECT c, predicted_category || ' from ' || true_category AS p FROM pat
            ORDER BY c DESC, predicted_category DESC, true_category DESC LIMIT 1),
    cls AS (SELECT CAST(max(c) AS DOUBLE) / min(c) AS r FROM (SELECT count(*) AS c FROM v_feedback GROUP BY true_category)),
    j AS (SELECT count(*) AS n, avg(CAST(predicted_category = true_category AS INTEGER)) AS acc,
                 (SELECT c FROM top) AS top_count, (SELECT p FROM top) AS top_pattern, (SELECT r FROM cls) AS imbalance
          FROM v_feedback),
    s AS (SELECT *, CASE WHEN n >= 50 THEN concat_ws(' | ',
             CASE WHEN top_count >= 5 THEN 'focused_retraining: Focus on distinguishing ' || top_pattern END,
             CASE WHEN imbalance > 3 THEN 'balance_training_data: Address class imbalance in training data' END,
             CASE WHEN acc < 0.8 THEN 'general_retraining: Improve overall model performance' END) ELSE '' END AS strategies
          FROM j)
    SELECT n >= 50 AND strategies <> '' AS should_retrain, strategies, acc AS feedback_accuracy,
           n AS total_feedback_samples FROM s""", ["v_feedback"], ["feedback_accuracy"])

reg("al_improvement", lambda s, sf: L.al_improvement(_fb(s, sf)),
    """SELECT CASE WHEN errors = 0 THEN 0.0 ELSE least(CAST(hc AS DOUBLE) / errors * 0.15, 1 - acc) END
              AS estimated_improvement
       FROM (SELECT count(*) FILTER (WHERE predicted_category <> true_category) AS errors,
                    count(*) FILTER (WHERE predicted_category <> true_category AND confidence > 0.8) AS hc,
                    avg(CAST(predicted_category = true_category AS INTEGER)) AS acc FROM v_feedback)""",
    ["v_feedback"], ["estimated_improvement"])

reg("ol_feedback_summary", lambda s, sf: L.ol_feedback_summary(_fb(s, sf)),
    f"""SELECT true_category, count(*) AS count,
        CAST(count(*) FILTER (WHERE predicted_category = true_category) AS DOUBLE) / count(*) AS accuracy
        FROM v_feedback WHERE ts > {ASOF} - INTERVAL 7 DAY GROUP BY 1""", ["v_feedback"], ["accuracy"])

reg("agg_feedback_by_category", lambda s, sf: L.ol_feedback_summary(_fb(s, sf), days=30),
    f"""SELECT true_category, count(*) AS count,
        CAST(count(*) FILTER (WHERE predicted_category = true_category) AS DOUBLE) / count(*) AS accuracy
        FROM v_feedback WHERE ts > {ASOF} - INTERVAL 30 DAY GROUP BY 1""", ["v_feedback"], ["accuracy"])

reg("win_top_feedback_users", lambda s, sf: L.win_top_feedback_users(_fb(s, sf)),
    f"""SELECT user_id, count(*) AS activity_count FROM v_feedback
        WHERE ts > {ASOF} - INTERVAL 7 DAY AND user_id IS NOT NULL
        GROUP BY 1 ORDER BY activity_count DESC, user_id LIMIT 10""", ["v_feedback"])

DAILY_SQL = """daily AS (
  SELECT date, sum(n) OVER w AS feedback_received, sum(ok) OVER w AS correct_predictions FROM (
    SELECT CAST(ts AS DATE) AS date, count(*) AS n,
           count(*) FILTER (WHERE predicted_category = true_category) AS ok FROM v_feedback GROUP BY 1)
  WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

reg("win_learning_trend", lambda s, sf: L.win_learning_trend(_fb(s, sf), days=30),
    f"""WITH {DAILY_SQL}
    SELECT date, CAST(feedback_received AS BIGINT) AS feedback_received,
           CAST(correct_predictions AS BIGINT) AS correct_predictions,
           CAST(floor(feedback_received / 50) AS BIGINT) AS model_updates,
           CAST(correct_predictions AS DOUBLE) / feedback_received AS current_accuracy
    FROM daily WHERE date > CAST({ASOF} - INTERVAL 30 DAY AS DATE)""", ["v_feedback"], ["current_accuracy"])

reg("ol_stats", lambda s, sf: L.ol_stats(_fb(s, sf), spark_view(s, sf, "v_predictions")),
    """SELECT count(*) AS feedback_received,
              count(*) FILTER (WHERE predicted_category = true_category) AS correct_predictions,
              (SELECT count(*) FROM v_predictions) AS total_predictions,
              CAST(floor(count(*) / 50) AS BIGINT) AS model_updates,
              CAST(count(*) FILTER (WHERE predicted_category = true_category) AS DOUBLE) / count(*) AS current_accuracy
       FROM v_feedback""", ["v_feedback", "v_predictions"], ["current_accuracy"])

reg("ol_low_confidence",
    lambda s, sf: L.ol_low_confidence(spark_view(s, sf, "v_predictions"), threshold=0.3).select("id", "confidence"),
    "SELECT id, confidence FROM v_predictions WHERE confidence < 0.3", ["v_predictions"], ["confidence"])

QUERIES = Q
