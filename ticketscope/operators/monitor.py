"""Performance monitoring over a prediction log.

Input schema (``schemas.PREDICTIONS``): model_name, ts, predicted_class,
confidence, actual_class, is_correct (nullable), latency_ms.

All windows are closed ``[as_of - N h, as_of]`` and evaluated in one scan
with conditional aggregates: one shuffle on ``model_name`` (after a
map-side partial aggregate), never a self-join of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ticketscope.constants import ALERT_COOLDOWN_MINUTES, MONITOR_THRESHOLDS
from ticketscope.operators._util import (as_of_col, epoch_micros, explode_fired, from_epoch_seconds, hours,
                                        minutes, safe_div)
from ticketscope.operators.cooldown import apply_cooldown
from ticketscope.operators.ranks import with_percentiles


#: Latency percentiles of the metrics.
LATENCY_SHARES = {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}


def _metric_aggs(cond: Column, window_hours: float, exact: bool) -> list[Column]:
    w = lambda c: F.when(cond, c)
    n = F.count_if(cond)
    return [
        F.avg(w(F.col("is_correct").cast("int"))).alias("accuracy"),
        F.count_if(cond & F.col("is_correct").isNotNull()).alias("total_labeled_predictions"),
        F.avg(w(F.col("confidence"))).alias("avg_confidence"),
        F.min(w(F.col("confidence"))).alias("min_confidence"),
        F.max(w(F.col("confidence"))).alias("max_confidence"),
        F.stddev_samp(w(F.col("confidence"))).alias("confidence_std"),
        F.avg(w(F.col("latency_ms"))).alias("avg_latency_ms"),
        *([] if exact else [F.percentile_approx(w(F.col("latency_ms")), q, 10000).alias(n) for n, q in LATENCY_SHARES.items()]),
        n.alias("total_predictions"),
        (n / F.lit(float(window_hours))).alias("predictions_per_hour"),
        safe_div(F.count_if(cond & (F.col("predicted_class") == "Error")), n).alias("error_rate"),
    ]


def mon_metrics(preds: DataFrame, *, as_of=None, window_hours: float = 24,
                model_name: str | None = None, exact_percentiles: bool = True) -> DataFrame:
    """Per-model metrics over ``[as_of - window, as_of]`` (one row per model).

    Percentiles are exact (linear interpolation, found by rank selection: no
    task holds a model's log); ``exact_percentiles=False`` takes the sketch's.
    """
    t = as_of_col(preds, as_of)
    lo = t - hours(window_hours)
    df = preds.where((F.col("ts") >= lo) & (F.col("ts") <= t))
    if model_name is not None:
        df = df.where(F.col("model_name") == model_name)
    out = df.groupBy("model_name").agg(*_metric_aggs(F.lit(True), window_hours, exact_percentiles))
    return with_percentiles(out, df, ["model_name"], "latency_ms", LATENCY_SHARES) if exact_percentiles else out


def mon_class_distribution(preds: DataFrame, *, as_of=None, window_hours: float = 24) -> DataFrame:
    """Normalised class distribution per model in the window (agg_value_shares)."""
    t = as_of_col(preds, as_of)
    df = preds.where((F.col("ts") >= t - hours(window_hours)) & (F.col("ts") <= t))
    c = df.groupBy("model_name", "predicted_class").agg(F.count("*").alias("n"))
    from pyspark.sql import Window
    return c.select("model_name", "predicted_class",
                    (F.col("n") / F.sum("n").over(Window.partitionBy("model_name"))).alias("share"))


def mon_baseline(preds: DataFrame, *, as_of=None, start_hours: float = 25,
                 end_hours: float = 1) -> DataFrame:
    """Baseline metrics over ``[as_of - 25 h, as_of - 1 h]`` (code's window)."""
    t = as_of_col(preds, as_of)
    df = preds.where((F.col("ts") >= t - hours(start_hours)) & (F.col("ts") <= t - hours(end_hours)))
    n = F.count("*")
    return df.groupBy("model_name").agg(
        F.avg(F.col("is_correct").cast("int")).alias("accuracy"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        safe_div(F.count_if(F.col("predicted_class") == "Error"), n).alias("error_rate"))


def _windowed_pair(preds: DataFrame, t: Column, cur_h: float, base_start_h: float,
                   base_end_h: float) -> DataFrame:
    """Current and baseline aggregates per model in ONE scan of the log."""
    ts = F.col("ts")
    cur = (ts >= t - hours(cur_h)) & (ts <= t)
    base = (ts >= t - hours(base_start_h)) & (ts <= t - hours(base_end_h))
    df = preds.where((ts >= t - hours(max(cur_h, base_start_h))) & (ts <= t))

    def block(cond, p):
        n = F.count_if(cond)
        return [n.alias(f"{p}_n"),
                F.avg(F.when(cond, F.col("is_correct").cast("int"))).alias(f"{p}_acc"),
                F.avg(F.when(cond, F.col("confidence"))).alias(f"{p}_conf"),
                F.avg(F.when(cond, F.col("latency_ms"))).alias(f"{p}_lat"),
                safe_div(F.count_if(cond & (F.col("predicted_class") == "Error")), n).alias(f"{p}_err")]

    return df.groupBy("model_name").agg(*block(cur, "cur"), *block(base, "base"))


def degradation_alerts(pair: DataFrame, th: dict | None = None) -> DataFrame:
    """Turn (cur_*, base_*) metric columns into alert rows (``explode``)."""
    th = {**MONITOR_THRESHOLDS, **(th or {})}
    # window averages are snapped to a 2^-20 grid before the threshold tests,
    # so a drop that is exactly a threshold in decimal (0.49 - 0.39) does not
    # flip with the summation order of the engine
    for c in ("cur_acc", "cur_conf", "cur_lat", "cur_err", "base_acc", "base_conf", "base_lat", "base_err"):
        pair = pair.withColumn(c, F.round(F.col(c) * 1048576.0) / 1048576.0)
    acc_drop = F.col("base_acc") - F.col("cur_acc")
    conf_drop = F.col("base_conf") - F.col("cur_conf")
    lat_ratio = safe_div(F.col("cur_lat"), F.col("base_lat"))
    err_inc = F.col("cur_err") - F.col("base_err")

    def alert(cond, typ, sev, metric, cur, thr, msg):
        return F.when(cond, F.struct(F.lit(typ).alias("alert_type"), sev.alias("severity"),
                                     F.lit(metric).alias("metric_name"),
                                     cur.cast("double").alias("current_value"),
                                     thr.cast("double").alias("threshold"), msg.alias("message")))

    # pre-round half-away-from-zero so the text does not depend on how a
    # formatter breaks exact ties
    snap = lambda x: F.round(x * 1048576.0) / 1048576.0
    pct = lambda x: F.format_string("%.2f%%", F.round(snap(x) * 10000) / 100)
    alerts = [
        alert(acc_drop > th["accuracy_drop"], "accuracy_degradation",
              F.when(acc_drop > 0.1, F.lit("high")).otherwise(F.lit("medium")), "accuracy",
              F.col("cur_acc"), F.col("base_acc") - th["accuracy_drop"],
              F.concat(F.lit("Accuracy dropped by "), pct(acc_drop), F.lit(" from baseline"))),
        alert(conf_drop > th["confidence_drop"], "confidence_degradation", F.lit("medium"),
              "avg_confidence", F.col("cur_conf"), F.col("base_conf") - th["confidence_drop"],
              F.concat(F.lit("Average confidence dropped by "), pct(conf_drop), F.lit(" from baseline"))),
        alert(lat_ratio > th["latency_increase"], "latency_increase",
              F.when(lat_ratio < 3, F.lit("low")).otherwise(F.lit("medium")), "avg_latency_ms",
              F.col("cur_lat"), F.col("base_lat") * th["latency_increase"],
              F.concat(F.lit("Average latency increased by "), F.format_string("%.1f", F.round(snap(lat_ratio) * 10) / 10),
                       F.lit("x from baseline"))),
        alert(err_inc > th["error_rate_increase"], "error_rate_increase", F.lit("high"), "error_rate",
              F.col("cur_err"), F.col("base_err") + th["error_rate_increase"],
              F.concat(F.lit("Error rate increased by "), pct(err_inc), F.lit(" from baseline"))),
    ]
    keep = [c for c in pair.columns if c in ("model_name", "check_ts")]
    fired = explode_fired(pair.where((F.col("cur_n") > 0) & (F.col("base_n") > 0)), keep, alerts)
    return fired.select(*keep, "a.*")


def mon_degradation(preds: DataFrame, *, as_of=None, current_hours: float = 1,
                    baseline_hours: tuple[float, float] = (25, 1),
                    thresholds: dict | None = None) -> DataFrame:
    """Alerts for every model: last hour against the 24 h before it."""
    t = as_of_col(preds, as_of)
    pair = _windowed_pair(preds, t, current_hours, baseline_hours[0], baseline_hours[1])
    return degradation_alerts(pair, thresholds).withColumn("ts", t)


def mon_degradation_checks(preds: DataFrame, *, check_minutes: int = 10,
                           current_hours: int = 1, baseline_hours: tuple[int, int] = (25, 1),
                           thresholds: dict | None = None) -> DataFrame:
    """Every periodic check over the whole log, as the monitoring loop would run.

    The log is pre-aggregated into (model, bucket) sums once (map-side
    combine, one shuffle); each check's current and baseline windows are
    range frames over the bucket index, so the cost is linear in buckets,
    not in checks x rows. Checks at bucket ends ``k * check_minutes``.
    Windows use half-open bucket ranges ``(t - N h, t]``.
    """
    from pyspark.sql import Window
    step = check_minutes * 60
    epoch = epoch_micros(F.col("ts")) if isinstance(
        preds.schema["ts"].dataType, TimestampNTZType) else F.unix_micros("ts")
    # bucket b covers (b*step - step, b*step]  ->  b = ceil(sec / step)
    b = F.ceil(epoch / F.lit(step * 1_000_000.0)).cast("long")
    agg = preds.groupBy("model_name", b.alias("b")).agg(
        F.count("*").alias("n"),
        F.count("is_correct").alias("n_lab"),
        F.sum(F.col("is_correct").cast("int")).alias("n_ok"),
        F.sum("confidence").alias("s_conf"),
        F.sum("latency_ms").alias("s_lat"),
        F.count_if(F.col("predicted_class") == "Error").alias("n_err"))
    per_h = 3600 // step
    # every check time whose current window holds data: each data bucket is
    # in the current window of the next current_hours*per_h checks (bounded
    # spine, at most that factor times the data buckets)
    spine = agg.select("model_name", F.explode(F.sequence(F.col("b"), F.col("b") + (current_hours * per_h - 1)))
                       .alias("b")).distinct()
    agg = spine.join(agg, ["model_name", "b"], "left")
    w = Window.partitionBy("model_name").orderBy("b")
    cur_w = w.rangeBetween(-(current_hours * per_h) + 1, 0)
    base_w = w.rangeBetween(-(baseline_hours[0] * per_h) + 1, -(baseline_hours[1] * per_h))

    def block(win, p):
        n = F.sum("n").over(win)
        return [n.alias(f"{p}_n"),
                safe_div(F.sum("n_ok").over(win), F.sum("n_lab").over(win)).alias(f"{p}_acc"),
                safe_div(F.sum("s_conf").over(win), n).alias(f"{p}_conf"),
                safe_div(F.sum("s_lat").over(win), n).alias(f"{p}_lat"),
                safe_div(F.sum("n_err").over(win), n).alias(f"{p}_err")]

    pair = agg.select("model_name", "b", *block(cur_w, "cur"), *block(base_w, "base"))
    pair = pair.withColumn("check_ts", from_epoch_seconds(F.col("b") * step))
    return degradation_alerts(pair.drop("b"), thresholds).withColumnRenamed("check_ts", "ts")


def mon_cooldown(alerts: DataFrame, *, cooldown_minutes: int = ALERT_COOLDOWN_MINUTES,
                 stored: DataFrame | None = None) -> DataFrame:
    """Suppress an alert if one of the same (type, model) was STORED < cooldown ago.

    Greedy: the kept alert resets the clock, suppressed ones do not (``lag``
    would be wrong). ``stored`` seeds the clock with already stored alerts. A
    key's time line is worked on in ranges (``cooldown``), so one key may hold
    most alerts.
    """
    return apply_cooldown(alerts, keys=["alert_type", "model_name"], gap_micros=int(cooldown_minutes * 60_000_000), stored=stored)


def mon_report(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """Good / Warning / Critical per model from its recent alerts."""
    a = alerts.groupBy("model_name").agg(
        F.count("*").alias("n_alerts"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("n_high"),
        F.count_if(F.col("alert_type") == "accuracy_degradation").alias("n_acc_alerts"),
        F.count_if(F.col("alert_type") == "latency_increase").alias("n_lat_alerts"))
    j = metrics.join(a, "model_name", "left").na.fill(0, ["n_alerts", "n_high", "n_acc_alerts", "n_lat_alerts"])
    status = (F.when(F.col("n_high") > 0, F.lit("Critical"))
              .when(F.col("n_alerts") > 0, F.lit("Warning")).otherwise(F.lit("Good")))
    return j.withColumn("performance_status", status).withColumn("recommendations", mon_recommend_col())


def mon_recommend_col() -> Column:
    """The ten threshold messages as an array (needs mon_report columns)."""
    acc = F.col("accuracy")
    msgs = [
        (acc.isNotNull() & (acc < 0.8), "Consider retraining the model with additional data"),
        (acc.isNotNull() & (acc < 0.9) & (F.coalesce(F.col("total_labeled_predictions"), F.lit(0)) < 100),
         "Collect more labeled data for better accuracy assessment"),
        (F.coalesce(F.col("avg_confidence"), F.lit(0.0)) < 0.7,
         "Low average confidence detected - consider model calibration"),
        (F.coalesce(F.col("confidence_std"), F.lit(0.0)) > 0.3,
         "High confidence variance - investigate prediction consistency"),
        (F.coalesce(F.col("avg_latency_ms"), F.lit(0.0)) > 1000,
         "High latency detected - optimize model inference"),
        (F.coalesce(F.col("p99_latency_ms"), F.lit(0.0)) > 5000,
         "Very high P99 latency - investigate performance bottlenecks"),
        (F.coalesce(F.col("error_rate"), F.lit(0.0)) > 0.05,
         "High error rate - investigate input validation and error handling"),
        (F.col("n_acc_alerts") > 0, "Accuracy degradation detected - investigate concept drift"),
        (F.col("n_lat_alerts") > 0,
         "Latency increase detected - check system resources and model complexity"),
        (F.coalesce(F.col("predictions_per_hour"), F.lit(0.0)) > 1000,
         "High prediction volume - consider caching and load balancing"),
    ]
    arr = F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in msgs]), lambda x: x.isNotNull())
    return F.when(F.size(arr) == 0, F.array(F.lit("Model performance is within acceptable ranges"))).otherwise(arr)


def mon_active_models(preds: DataFrame, *, as_of=None, days: int = 1) -> DataFrame:
    """Models with predictions in the last day (set_distinct_models)."""
    t = as_of_col(preds, as_of)
    return preds.where(F.col("ts") > t - F.make_dt_interval(F.lit(days))).select("model_name").distinct()


def mon_rolling_buffer(preds: DataFrame, *, n: int = 1000) -> DataFrame:
    """Last ``n`` (ts, value) per (model, metric): confidence, latency, accuracy."""
    from pyspark.sql import Window
    long = preds.select("model_name", "ts", F.col("id"), F.inline(F.array(
        F.struct(F.lit("confidence").alias("metric"), F.col("confidence").cast("double").alias("value")),
        F.struct(F.lit("latency").alias("metric"), F.col("latency_ms").cast("double").alias("value")),
        F.struct(F.lit("accuracy").alias("metric"), F.col("is_correct").cast("int").cast("double").alias("value")))))
    long = long.where(F.col("value").isNotNull())
    w = Window.partitionBy("model_name", "metric").orderBy(F.desc("ts"), F.desc("id"))
    return long.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def metrics_long(metrics: DataFrame, *, window_size: int) -> DataFrame:
    """snk_metrics_long: every numeric metric as one row (``unpivot``)."""
    num = [f.name for f in metrics.schema.fields
           if f.name != "model_name" and f.dataType.typeName() in ("double", "long", "integer")]
    m = metrics.select("model_name", *[F.col(c).cast("double").alias(c) for c in num])
    return (m.unpivot(["model_name"], num, "metric_name", "metric_value")
            .where(F.col("metric_value").isNotNull())
            .withColumn("window_size", F.lit(window_size)))


__all__ = ["mon_metrics", "mon_class_distribution", "mon_baseline", "mon_degradation",
           "mon_degradation_checks", "degradation_alerts", "mon_cooldown", "mon_report",
           "mon_recommend_col", "mon_active_models", "mon_rolling_buffer", "metrics_long",
           "minutes"]
