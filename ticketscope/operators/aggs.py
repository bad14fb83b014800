"""Dashboard aggregates, filters and projections over ticket tables.

Everything here is a single ``groupBy`` (partial aggregate on the map side,
one shuffle on the grouping keys) or a narrow projection. Shares use a
window over the already-aggregated counts, never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.constants import CONFIDENCE_HIGH, CONFIDENCE_MEDIUM, PRIORITY_LEVELS
from ticketscope.operators._util import epoch_micros, safe_div
from ticketscope.operators.ranks import with_percentiles


# ----------------------------------------------------------------- filters

def flt_required_notnull(df: DataFrame, required=("customer_message", "category")) -> DataFrame:
    return df.dropna(subset=list(required))


def flt_nonempty_text(df: DataFrame, col: str = "processed_text") -> DataFrame:
    return df.where(F.length(F.col(col)) > 0)


def flt_dashboard(df: DataFrame, *, category="All", priority="All", channel="All", source="All",
                  confidence_range: tuple[float, float] | None = None,
                  category_col: str = "category") -> DataFrame:
    """Optional equality filters ("All" = no filter) and a closed confidence range."""
    for col, val in ((category_col, category), ("priority", priority), ("channel", channel),
                     ("data_source", source)):
        if val != "All" and col in df.columns:
            df = df.where(F.col(col) == val)
    if confidence_range is not None:
        df = df.where(F.col("confidence").between(*confidence_range))
    return df


def flt_time_window(df: DataFrame, *, as_of, days: float | None = None, hours: float | None = None,
                    start=None, end=None, ts: str = "ts") -> DataFrame:
    """``ts > as_of - N`` or the closed range ``[start, end]``; pushes to the scan."""
    c = F.col(ts)
    if days is not None or hours is not None:
        secs = int((days or 0) * 86400 + (hours or 0) * 3600)
        df = df.where(c > as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(secs)))
    if start is not None:
        df = df.where(c >= start)
    if end is not None:
        df = df.where(c <= end)
    return df


def flt_event_types(df: DataFrame, event_types=None, col: str = "event_type") -> DataFrame:
    return df if not event_types else df.where(F.col(col).isin(list(event_types)))


def flt_text_search(df: DataFrame, needle: str, col: str = "customer_message",
                    regex: bool = False) -> DataFrame:
    c = F.col(col)
    return df.where(c.rlike(needle) if regex else F.contains(F.lower(c), F.lit(needle.lower())))


def flt_high_low_confidence(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts and shares above/below the threshold (one row)."""
    n = F.count("*")
    hi = F.count_if(F.col("confidence") >= threshold)
    lo = F.count_if(F.col("confidence") < threshold)
    return df.agg(n.alias("total"), hi.alias("high_confidence_count"),
                  lo.alias("low_confidence_count"),
                  (safe_div(hi, n) * 100).alias("high_confidence_pct"),
                  (safe_div(lo, n) * 100).alias("low_confidence_pct"))


def flt_error_predictions(df: DataFrame, col: str = "predicted_class") -> DataFrame:
    return df.where(F.col(col) == "Error")


# ------------------------------------------------------------- projections

def confidence_band(col: str = "confidence") -> Column:
    c = F.col(col)
    return (F.when(c >= CONFIDENCE_HIGH, F.lit("high"))
            .when(c >= CONFIDENCE_MEDIUM, F.lit("medium")).otherwise(F.lit("low")))


def prj_confidence_band(df: DataFrame, col: str = "confidence") -> DataFrame:
    return df.withColumn("confidence_band", confidence_band(col))


def preview_text(col: str = "customer_message", n: int = 100) -> Column:
    c = F.col(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def prj_preview(df: DataFrame, columns=None, text_col: str = "customer_message", n: int = 100) -> DataFrame:
    default = ["ticket_id", "customer_message", "category", "priority", "channel", "ts", "data_source"]
    cols = [c for c in (columns or default) if c in df.columns]
    return df.select(*[preview_text(c, n).alias(c) if c == text_col else F.col(c) for c in cols])


def prj_ticket_lookup(df: DataFrame, ticket_id, id_col: str = "ticket_id") -> DataFrame:
    return df.where(F.col(id_col) == ticket_id)


def prob_column_name(cls: str) -> str:
    return "prob_" + cls.lower().replace(" ", "_").replace("&", "and")


def prj_prob_columns(df: DataFrame, classes, map_col: str = "probabilities") -> DataFrame:
    """Probability map -> one ``prob_<class>`` column per known class (0.0 default)."""
    return df.select("*", *[F.coalesce(F.try_element_at(F.col(map_col), F.lit(c)), F.lit(0.0))
                            .alias(prob_column_name(c)) for c in classes])


def prj_version_id(model_name: Column, version: Column, created: Column) -> Column:
    """``name_v<ver>_<first 8 hex of md5(name_ver_ts)>``."""
    stamp = F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(model_name, F.lit("_v"), version, F.lit("_"),
                    F.substring(F.md5(F.concat_ws("_", model_name, version, stamp)), 1, 8))


# ------------------------------------------------------------ aggregations

def agg_value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts per value, descending (ties by value for a stable order)."""
    return df.groupBy(col).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.col(col))


def agg_value_shares(df: DataFrame, col: str) -> DataFrame:
    c = df.groupBy(col).agg(F.count("*").alias("count"))
    return c.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def agg_grouping_sets(df: DataFrame, dims=("category", "priority", "channel")) -> DataFrame:
    """All per-dimension value counts from ONE shuffle (GROUPING SETS).

    Output: (dimension, value, count). ``value`` is cast to string.
    """
    dims = [d for d in dims if d in df.columns]
    g = df.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.count("*").alias("cnt"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    dim = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dims])
    val = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.col(d).cast("string")) for d in dims])
    return g.select(dim.alias("dimension"), val.alias("value"), F.col("cnt").alias("count"))


def agg_overall_stats(df: DataFrame, *, category_col="category", high_value="High") -> DataFrame:
    """Total, distinct categories / channels, high-priority count, date span (days)."""
    span = F.floor((epoch_micros(F.max("ts")) - epoch_micros(F.min("ts"))) / F.lit(86_400_000_000))
    return df.agg(
        F.count("*").alias("total_tickets"),
        F.countDistinct(category_col).alias("unique_categories"),
        F.count_if(F.col("priority") == high_value).alias("high_priority"),
        F.countDistinct("channel").alias("channels"),
        span.cast("long").alias("date_range_days"))


def agg_metrics_cards(df: DataFrame, *, category_col="predicted_category") -> DataFrame:
    """One row: total, mean confidence, >=0.8 and <0.5 counts and %, modal category.

    The modal category comes from a second, already-aggregated input (the
    per-category counts), so no value ever travels with the raw rows.
    """
    n = F.count("*")
    hi = F.count_if(F.col("confidence") >= CONFIDENCE_HIGH)
    lo = F.count_if(F.col("confidence") < CONFIDENCE_MEDIUM)
    cards = df.agg(n.alias("total_tickets"), F.avg("confidence").alias("avg_confidence"),
                   hi.alias("high_confidence"), (safe_div(hi, n) * 100).alias("high_confidence_pct"),
                   lo.alias("low_confidence"), (safe_div(lo, n) * 100).alias("low_confidence_pct"))
    counts = df.groupBy(category_col).agg(F.count("*").alias("n"))
    modal = counts.select(F.max_by(F.col(category_col), F.struct(F.col("n"), F.col(category_col)))
                          .alias("most_common_category")).scalar()
    return cards.withColumn("most_common_category", modal)


def agg_conf_by_category(df: DataFrame, *, category_col="predicted_category") -> DataFrame:
    return df.groupBy(category_col).agg(F.count("*").alias("count"),
                                        F.avg("confidence").alias("mean_confidence"),
                                        F.stddev_samp("confidence").alias("std_confidence"))


def agg_prediction_analysis(df: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Total, mean/min/max confidence, high/low counts (one row)."""
    return df.agg(F.count("*").alias("total_predictions"),
                  F.avg("confidence").alias("avg_confidence"),
                  F.min("confidence").alias("min_confidence"),
                  F.max("confidence").alias("max_confidence"),
                  F.count_if(F.col("confidence") >= threshold).alias("high_confidence_count"),
                  F.count_if(F.col("confidence") < threshold).alias("low_confidence_count"))


def agg_summary_report(df: DataFrame, *, category_col="predicted_category") -> DataFrame:
    """Per category: count, share of all (%), mean confidence, and a report line."""
    g = df.groupBy(category_col).agg(F.count("*").alias("count"),
                                     F.avg("confidence").alias("mean_confidence"))
    pct = F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy())
    g = g.withColumn("percentage", pct)
    line = F.format_string("- **%s**: %d tickets (%.1f%%)", F.col(category_col), F.col("count"),
                           F.round(F.col("percentage") * 10) / 10)
    return g.withColumn("report_line", line)


def agg_daily_volume(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("date")).agg(F.count("*").alias("count")).orderBy("date")


def agg_hourly_volume(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("count")).orderBy("hour")


def agg_crosstab(df: DataFrame, row: str = "category", col: str = "priority", values=None) -> DataFrame:
    """Contingency table; known pivot values avoid an extra distinct pass."""
    values = list(values) if values is not None else PRIORITY_LEVELS
    return df.groupBy(row).pivot(col, values).count().na.fill(0)


def agg_conf_histogram(df: DataFrame, bins: int = 20, col: str = "confidence") -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed), empty bins included."""
    lo = df.select(F.min(col)).scalar()
    hi = df.select(F.max(col)).scalar()
    w = hi - lo
    b = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - lo) * bins / w), F.lit(bins - 1))).cast("int")
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = spine.join(F.broadcast(counts), "bin", "left").na.fill(0, ["count"])
    return out.select("bin", (lo + F.col("bin") * w / bins).alias("bin_start"),
                      (lo + (F.col("bin") + 1) * w / bins).alias("bin_end"), "count")


def agg_conf_box(df: DataFrame, *, category_col="predicted_category", col="confidence") -> DataFrame:
    """Box plot numbers per category; the quartiles by rank selection."""
    g = df.groupBy(category_col).agg(F.min(F.col(col).cast("double")).alias("min"), F.max(F.col(col).cast("double")).alias("max"))
    q = with_percentiles(g, df, [category_col], col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.select(category_col, "min", "q1", "median", "q3", "max")


def agg_data_quality(df: DataFrame) -> DataFrame:
    """Per column: nulls, completeness; plus duplicate-row count (one pass + one distinct)."""
    cols = df.columns
    nulls = df.agg(F.count("*").alias("_n"),
                   *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    long = nulls.unpivot(["_n"], cols, "column_name", "missing")
    # duplicates = rows - distinct rows; rows are compared through a SHA-256 of
    # their JSON form, so only 64-char keys are shuffled, not whole rows
    row_hash = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols])), 256)
    dup = df.select(row_hash.alias("_h")).agg(
        (F.count("*") - F.countDistinct("_h")).alias("dups")).scalar()
    return long.select("column_name", "missing",
                       (1 - F.col("missing") / F.col("_n")).alias("completeness"),
                       dup.alias("duplicate_rows"))


def agg_class_distribution(df: DataFrame, label_col: str = "category") -> DataFrame:
    return df.groupBy(label_col).agg(F.count("*").alias("count"))


def agg_common_words(df: DataFrame, text_col: str = "text", top_k: int = 100) -> DataFrame:
    """Top-k lower-cased whitespace tokens (ties by word)."""
    w = df.select(F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("word")).where(F.col("word") != "")
    c = w.groupBy("word").agg(F.count("*").alias("count"))
    return c.orderBy(F.desc("count"), "word").limit(top_k)


def agg_text_ref_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda x: x != "")
    base = df.agg(F.avg(F.length(text_col)).alias("avg_length"),
                  F.avg(F.size(words)).alias("avg_word_count"))
    vocab = (df.select(F.explode(F.filter(F.split(F.lower(F.col(text_col)), r"\s+"), lambda x: x != "")).alias("w"))
             .agg(F.countDistinct("w")).scalar())
    return base.withColumn("vocab_size", vocab)


def agg_feature_ref_stats(df: DataFrame, features, exact: bool = True) -> DataFrame:
    """Per feature: mean, population std, min, max, p25/50/75/90/95/99 (long form)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                   F.col(f).cast("double").alias("value"))
                                          for f in features])).alias("s")).select("s.*")
    ps = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    return reference_stats(long, ps, exact)


def reference_stats(long: DataFrame, shares=(0.25, 0.5, 0.75, 0.9, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """The statistics of ``agg_feature_ref_stats`` over rows (feature, value)."""
    names = {f"p{int(p * 100)}": p for p in shares}
    approx = [] if exact else [F.percentile_approx("value", p, 10000).alias(n) for n, p in names.items()]
    g = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                    F.min("value").alias("min"), F.max("value").alias("max"), *approx)
    g = with_percentiles(g, long, ["feature"], "value", names) if exact else g
    return g.select("feature", "mean", "std", "min", "max", *names)
