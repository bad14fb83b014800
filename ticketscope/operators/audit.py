"""Audit trail, compliance rules, retention and GDPR requests.

Compliance rules are a table of any size, bucketed by threshold: an event
meets the buckets up to its own value in an equi-join, never all rules. GDPR identity matching
``user_id = req.user_id OR user_id = req.email`` is rewritten into an
equi-join on an exploded identity list, so it plans as a hash join
instead of a nested loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.operators._util import as_of_col, epoch_micros
from ticketscope.operators.intervals import above_thresholds
from ticketscope.operators.windows import win_top_users

# The three default compliance rules.
DEFAULT_RULES = [
    {"rule_id": "data_retention", "name": "Data Retention Policy", "rule_type": "retention",
     "severity": "high", "enabled": True, "retention_days": 365, "confidence_floor": None},
    {"rule_id": "bias_monitoring", "name": "Model Bias Monitoring", "rule_type": "bias",
     "severity": "high", "enabled": True, "retention_days": None, "confidence_floor": 0.5},
    {"rule_id": "access_logging", "name": "Access Logging", "rule_type": "access",
     "severity": "medium", "enabled": True, "retention_days": None, "confidence_floor": None},
]


RULE_COLUMNS = ("rule_id string, name string, rule_type string, severity string, enabled boolean, retention_days int, "
                "confidence_floor double")


def rules_table(spark, rules=None) -> DataFrame:
    """The rules as a table: given as one, as a list of dicts, or the defaults."""
    if isinstance(rules, DataFrame):
        return rules
    names = [c.split()[0] for c in RULE_COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, True if n == "enabled" else None) for n in names)
                                  for r in (DEFAULT_RULES if rules is None else rules)], RULE_COLUMNS)


# ------------------------------------------------------------ event build

def prj_sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def prj_lineage(data: Column, source_type: str, ts: Column) -> Column:
    return F.struct(F.lit(source_type).alias("source_type"), ts.alias("ts"),
                    F.array().cast("array<string>").alias("transformations"),
                    F.sha2(data.cast("string"), 256).alias("data_hash"))


def prj_event_build(df: DataFrame, *, kind: str, gdpr: bool = True, as_of=None) -> DataFrame:
    """Build audit events of one kind from raw rows.

    kinds: prediction (model_id, input_text, prediction, confidence, user_id),
    training (model_id, dataset_info, params, results, user_id),
    model_update (model_id, update_type, changes, user_id),
    access (model_id, access_type, user_id).
    ``event_id`` is a deterministic hash of the row (idempotent re-runs).
    """
    ts = F.col("ts") if "ts" in df.columns else as_of_col(df, as_of)
    uid = F.col("user_id").cast("string") if "user_id" in df.columns else F.lit(None).cast("string")
    if kind == "prediction":
        tags = F.array(F.lit("prediction"), F.lit("gdpr_relevant")) if gdpr else F.array(F.lit("prediction"))
        out = F.create_map(F.lit("prediction"), F.col("prediction").cast("string"),
                           F.lit("confidence"), F.col("confidence").cast("string"))
        h = prj_sha256(F.col("input_text"))
        lineage = prj_lineage(F.col("input_text"), "user_input", ts)
    elif kind == "training":
        tags = F.array(F.lit("training"), F.lit("model_creation"))
        out = F.create_map(F.lit("training_params"), F.to_json("params"), F.lit("results"), F.to_json("results"))
        h = prj_sha256(F.to_json("dataset_info"))
        lineage = prj_lineage(F.to_json("dataset_info"), "training_data", ts)
    elif kind == "model_update":
        tags = F.array(F.lit("model_modification"))
        out = F.create_map(F.lit("update_type"), F.col("update_type"), F.lit("changes"), F.to_json("changes"))
        h = prj_sha256(F.to_json("changes"))
        lineage = F.lit(None).cast("struct<source_type:string,ts:timestamp,transformations:array<string>,data_hash:string>")
    elif kind == "access":
        tags = F.array(F.lit("access"))
        out = F.create_map(F.lit("access_type"), F.col("access_type"))
        h = F.lit("")
        lineage = F.lit(None).cast("struct<source_type:string,ts:timestamp,transformations:array<string>,data_hash:string>")
    else:
        raise ValueError(f"unknown event kind {kind!r}")
    micros = epoch_micros(ts).cast("string")
    eid = F.sha2(F.concat_ws("|", F.lit(kind), F.col("model_id"), uid, micros, h), 256)
    return df.select(eid.alias("event_id"), ts.alias("ts"), F.lit(kind).alias("event_type"),
                     uid.alias("user_id"), F.col("model_id"), h.alias("input_data_hash"),
                     out.alias("output_data"), tags.alias("compliance_tags"), lineage.alias("data_lineage"))


# --------------------------------------------------------------- rules

def aud_rule_eval(events: DataFrame, rules=None, *, as_of=None) -> DataFrame:
    """Violation rows for every enabled rule that fires on an event.

    retention: whole days between event and ``as_of`` > retention_days
    (detected at ``as_of``); bias: prediction events with confidence below
    the floor (detected when logged); access: never a violation.
    """
    t = as_of_col(events, as_of)
    age_days = F.floor((epoch_micros(t) - epoch_micros(F.col("ts"))) / F.lit(86_400_000_000))
    conf = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in events.columns else F.lit(1.0)
    # both kinds fire above a threshold: days kept, and minus the confidence floor
    rules = rules_table(events.sparkSession, rules).where(F.coalesce("enabled", F.lit(True)) & F.col("rule_type").isin("retention", "bias"))
    days = F.when(F.col("retention_days") != 0, F.col("retention_days")).otherwise(365)
    floor = F.when(F.col("confidence_floor") != 0, F.col("confidence_floor")).otherwise(0.5)
    retention = F.col("rule_type") == "retention"
    rules = rules.select("rule_id", "severity", "rule_type",
                         F.when(retention, F.coalesce(days, F.lit(365)).cast("double")).otherwise(-F.coalesce(floor, F.lit(0.5))).alias("threshold"))
    measures = F.array(
        F.struct(F.lit("retention").alias("kind"), age_days.cast("double").alias("value"), t.alias("v_ts")),
        F.when(F.col("event_type") == "prediction", F.struct(
            F.lit("bias").alias("kind"), (-conf).cast("double").alias("value"), F.col("ts").alias("v_ts"))))
    facts = events.select("event_id", F.explode(measures).alias("m")).where("m is not null").select("event_id", "m.*")
    v = above_thresholds(facts, rules.withColumnRenamed("rule_type", "kind"), kind="kind", value="value",
                         width={"retention": 30.0, "bias": 0.05})
    said = F.when(F.col("kind") == "retention", F.format_string("Event exceeds retention period of %d days", F.col("threshold").cast("int"))
                  ).otherwise(F.lit("Potential bias detected in prediction"))
    return v.select(F.concat_ws(":", "rule_id", F.col("event_id").cast("string")).alias("violation_id"),
                    F.col("v_ts").alias("ts"), "rule_id", "event_id", "severity", said.alias("description"),
                    F.lit(False).alias("resolved"))


# -------------------------------------------------------------- reports

def _period(df: DataFrame, start, end, event_types=None, as_of=None, days: int = 30) -> DataFrame:
    t = as_of_col(df, as_of)
    lo = start if start is not None else t - F.make_dt_interval(F.lit(days))
    hi = end if end is not None else t
    d = df.where(F.col("ts").between(lo, hi))
    if event_types:
        d = d.where(F.col("event_type").isin(list(event_types)))
    return d


def agg_audit_event_stats(events: DataFrame, *, start=None, end=None, event_types=None, as_of=None) -> DataFrame:
    return _period(events, start, end, event_types, as_of).groupBy("event_type").agg(F.count("*").alias("count"))


def agg_audit_model_usage(events: DataFrame, *, start=None, end=None, event_types=None, as_of=None) -> DataFrame:
    d = _period(events, start, end, event_types, as_of)
    return d.groupBy("model_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "model_id")


def agg_audit_top_users(events: DataFrame, *, start=None, end=None, event_types=None, as_of=None,
                        n: int = 10) -> DataFrame:
    return win_top_users(_period(events, start, end, event_types, as_of), user_col="user_id", n=n)


def agg_audit_violations(violations: DataFrame, *, start=None, end=None, as_of=None) -> DataFrame:
    d = _period(violations, start, end, None, as_of)
    return d.groupBy("rule_id", "severity").agg(F.count("*").alias("count"))


def aud_report(events: DataFrame, violations: DataFrame, *, start=None, end=None, event_types=None,
               as_of=None) -> DataFrame:
    """Summary row: total events, distinct users and models, violations (true counts)."""
    d = _period(events, start, end, event_types, as_of)
    s = d.agg(F.count("*").alias("total_events"), F.countDistinct("user_id").alias("unique_users"),
              F.countDistinct("model_id").alias("models_accessed"))
    nv = _period(violations, start, end, None, as_of).agg(F.count("*")).scalar()
    return s.withColumn("compliance_violations", nv)


def agg_recent_violations(violations: DataFrame, *, as_of=None, days: int = 7) -> DataFrame:
    """Last-7-day violations by severity, plus the unresolved total (one scan)."""
    t = as_of_col(violations, as_of)
    recent = F.col("ts") > t - F.make_dt_interval(F.lit(days))
    g = violations.groupBy("severity").agg(F.count_if(recent).alias("recent_count"),
                                           F.count_if(~F.col("resolved")).alias("unresolved"))
    return g


def aud_status(rules: DataFrame, violations: DataFrame, *, as_of=None, days: int = 7) -> DataFrame:
    """Per rule: name, enabled, severity, recent and unresolved violations."""
    t = as_of_col(violations, as_of)
    recent = F.col("ts") > t - F.make_dt_interval(F.lit(days))
    v = violations.groupBy("rule_id").agg(F.count_if(recent).alias("recent_violations"),
                                          F.count_if(~F.col("resolved")).alias("unresolved_violations"))
    return (rules.select("rule_id", "name", "enabled", "severity").join(v, "rule_id", "left")
            .na.fill(0, ["recent_violations", "unresolved_violations"]))


def aud_retention_purge(tables: dict[str, DataFrame], *, as_of=None,
                        retention_days: int = 365) -> tuple[dict[str, DataFrame], DataFrame]:
    """Retention over several tables with a ``ts`` (audit events, compliance
    violations): the kept rows of each, and the counts ``(source, deleted_count,
    kept_count)`` with a last row ``total``. Rows older than the cutoff go; rows
    without a time stay. ``as_of`` defaults to the newest row of the first table.

    Writing a kept table back per date partition (``partitionOverwriteMode=
    dynamic``) rewrites only partitions that held expired rows.
    """
    t = as_of_col(next(iter(tables.values())), as_of)
    expired = F.coalesce(F.col("ts") < t - F.make_dt_interval(F.lit(retention_days)), F.lit(False))
    kept = {name: df.where(~expired) for name, df in tables.items()}
    marks = reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("source"), expired.alias("gone"))
                                        for name, df in tables.items()])
    n = marks.groupBy("source").agg(F.count_if("gone").alias("deleted_count"), F.count_if(~F.col("gone")).alias("kept_count"))
    names = df_of_names(n.sparkSession, list(tables))
    n = names.join(n, "source", "left").na.fill(0, ["deleted_count", "kept_count"])
    return kept, n.unionByName(n.agg(F.lit("total").alias("source"), F.sum("deleted_count").alias("deleted_count"),
                                     F.sum("kept_count").alias("kept_count")))


def df_of_names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "source string")


# ----------------------------------------------------------------- GDPR

def gdpr_identities(requests: DataFrame) -> DataFrame:
    """(request_id, request_type, identity): user_id and e-mail, non-null, distinct."""
    ids = requests.select("request_id", "request_type",
                          F.explode(F.array_compact(F.array("user_id", "email"))).alias("identity"))
    return ids.distinct()


#: Parts that one identity's events are split into in the identity joins.
SALTS = 16


def _salted(events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events dealt over ``SALTS`` parts by their time, identities repeated for each
    part: a user with most of the events does not end in one task."""
    part = F.pmod(F.xxhash64("ts"), F.lit(SALTS)).cast("int") if "ts" in events.columns else F.lit(0)
    return events.withColumn("_part", part), ids.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def join_gdpr_or(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Events of each requester: ``user_id IN (req.user_id, req.email)`` as an equi-join."""
    ev, ids = _salted(events, gdpr_identities(requests))
    return ids.join(ev, (ids["identity"] == ev["user_id"]) & (ids["_part"] == ev["_part"])).drop("identity", "_part")


def aud_gdpr_access(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Per access/portability request: matched events (long form) for export."""
    req = requests.where(F.col("request_type").isin("access", "portability"))
    return join_gdpr_or(events, req)


def aud_gdpr_counts(events: DataFrame, requests: DataFrame) -> DataFrame:
    """total_events per request (0 when nothing matches)."""
    m = join_gdpr_or(events, requests).groupBy("request_id").agg(F.count("*").alias("total_events"))
    return (requests.select("request_id", "request_type", "user_id", "email")
            .join(m, "request_id", "left").na.fill(0, ["total_events"]))


def join_gdpr_erase(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Events left after erasing every deletion requester (left anti join)."""
    ids = gdpr_identities(requests.where(F.col("request_type") == "deletion")).select("identity").distinct()
    ev, ids = _salted(events, ids)
    return ev.join(ids, (ev["user_id"] == ids["identity"]) & (ev["_part"] == ids["_part"]), "left_anti").drop("_part")


def aud_gdpr_process(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Process all pending requests at once: status completed and the response."""
    counts = aud_gdpr_counts(events, requests.where(F.col("status") == "pending"))
    t = F.col("request_type")
    resp = (F.when(t == "access", F.lit("data"))
            .when(t == "deletion", F.lit("deleted_records"))
            .when(t == "portability", F.lit("exportable_data"))
            .otherwise(F.concat(F.lit("error: Unsupported request type: "), t)))
    return counts.select("request_id", "request_type", resp.alias("response_kind"),
                         F.col("total_events").alias("affected_records"), F.lit("completed").alias("status"))


def aud_gdpr_create(spark, request_type: str, user_id=None, email=None, *, enabled: bool = True,
                    as_of=None) -> DataFrame:
    """One pending request row with a fresh uuid; error when GDPR is off."""
    if not enabled:
        raise ValueError("GDPR features not enabled")
    df = spark.createDataFrame([(request_type, user_id, email)],
                               "request_type string, user_id string, email string")
    ts = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return df.select(F.expr("uuid()").alias("request_id"), "request_type", "user_id", "email",
                     ts.alias("ts"), F.lit("pending").alias("status"))


def aud_gdpr_delete(events: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining events, deleted count per deletion request)."""
    dele = requests.where(F.col("request_type") == "deletion")
    counts = aud_gdpr_counts(events, dele).select("request_id", F.col("total_events").alias("deleted_records"))
    return join_gdpr_erase(events, requests), counts


def aud_gdpr_create_batch(requests: DataFrame, *, enabled: bool = True) -> DataFrame:
    """Many pending requests at once (fresh uuid ids)."""
    if not enabled:
        raise ValueError("GDPR features not enabled")
    return requests.select(F.expr("uuid()").alias("request_id"), "request_type", "user_id", "email",
                           F.current_timestamp().alias("ts"), F.lit("pending").alias("status"))
