"""Model registry queries, A/B tests, traffic routing and version comparison.

Registry: (model_name, version, creation_date, performance_metrics MAP,
version_id). Performance log: (version_id, ts, metrics MAP). A/B test
configurations are a table of any size: routing joins requests to an
interval index of it on time buckets (first active test wins).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.functions.stats import t_p_udf
from ticketscope.functions.text import fn_hash_md5_bucket
from ticketscope.operators._util import as_of_col, epoch_micros
from ticketscope.operators.intervals import FirstMatch


def prj_version_id(model_name: Column, version: Column, created: Column) -> Column:
    """``<name>_v<version>_<first 8 hex of md5("<name>_<version>_<yyyymmdd_HHMMSS>")>``."""
    stamp = F.date_format(created, "yyyyMMdd_HHmmss")
    return F.concat(model_name, F.lit("_v"), version, F.lit("_"),
                    F.substring(F.md5(F.concat_ws("_", model_name, version, stamp)), 1, 8))


def with_version_id(registry: DataFrame) -> DataFrame:
    return registry.withColumn("version_id", prj_version_id(F.col("model_name"), F.col("version"),
                                                            F.col("creation_date")))


def ver_list(registry: DataFrame, model_name: str | None = None) -> DataFrame:
    return registry if model_name is None else registry.where(F.col("model_name") == model_name)


def win_latest_version(registry: DataFrame) -> DataFrame:
    """Newest version per model (ties by version text)."""
    w = Window.partitionBy("model_name").orderBy(F.desc("creation_date"), F.desc("version"))
    return registry.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def win_best_version(registry: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Highest ``metric`` per model; versions lacking the metric are skipped;
    ties go to the earliest registered version."""
    m = F.col("performance_metrics")
    v = registry.where(F.map_contains_key(m, F.lit(metric))).withColumn("metric_value", m[metric])
    w = Window.partitionBy("model_name").orderBy(F.desc("metric_value"), "creation_date", "version")
    return v.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def win_rollback_target(registry: DataFrame, deployed: DataFrame) -> DataFrame:
    """Newest version of the deployed model that is older than the deployed one.

    ``deployed``: (model_name, version) currently serving (quirk 12).
    """
    d = deployed.select(F.col("model_name").alias("_m"), F.col("version").alias("deployed_version"))
    reg = registry.alias("r")
    cur = reg.join(d, (F.col("r.model_name") == F.col("_m")) & (F.col("r.version") == F.col("deployed_version"))) \
        .groupBy("_m", "deployed_version").agg(F.max(F.col("r.creation_date")).alias("deployed_created")) \
        .select("_m", "deployed_created", "deployed_version")  # a version registered often counts once, by its newest entry
    older = registry.join(cur, registry["model_name"] == cur["_m"]).where(
        F.col("creation_date") < F.col("deployed_created")).drop("_m")
    w = Window.partitionBy("model_name").orderBy(F.desc("creation_date"), F.desc("version"))
    return older.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def win_next_version(registry: DataFrame, model_names: DataFrame | None = None) -> DataFrame:
    """Max semantic version (3 integer parts; others ignored), patch + 1; none -> 1.0.0."""
    parts = F.split("version", r"\.")
    ok = (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike("^-?[0-9]+$"))
    arr = F.transform(parts, lambda p: p.cast("long"))
    mx = registry.where(ok).groupBy("model_name").agg(F.max(arr).alias("mx"))
    names = model_names if model_names is not None else registry.select("model_name").distinct()
    j = names.join(mx, "model_name", "left")
    nxt = F.concat_ws(".", F.col("mx")[0].cast("string"), F.col("mx")[1].cast("string"),
                      (F.col("mx")[2] + 1).cast("string"))
    # concat_ws skips nulls, so the "no valid version" case is tested explicitly
    return j.select("model_name", F.when(F.col("mx").isNull(), F.lit("1.0.0")).otherwise(nxt).alias("next_version"))


# ------------------------------------------------------------------ A/B tests

def ab_test_id(name: str, created: _dt.datetime) -> str:
    return f"ab_test_{name}_{created.strftime('%Y%m%d_%H%M%S')}"


def ab_create(configs: DataFrame, registry: DataFrame) -> DataFrame:
    """Configs whose model_a / model_b are missing from the registry (invalid tests)."""
    ids = registry.select(F.col("version_id").alias("vid"))
    a = configs.join(ids, configs.model_a == ids.vid, "left_anti")
    b = configs.join(ids, configs.model_b == ids.vid, "left_anti")
    return a.unionByName(b).distinct()


TEST_COLUMNS = "rank long, test_id string, model_a string, model_b string, traffic_split double, start_date string, end_date string"


def _tests_table(spark, tests) -> DataFrame:
    """Tests with their rank: a list's order; a table's own ``rank``, else by start and id."""
    if isinstance(tests, DataFrame):
        rank = F.col("rank") if "rank" in tests.columns else F.struct("start_date", "test_id")
        return tests.withColumn("rank", rank)
    rows = [(i, t["test_id"], t["model_a"], t["model_b"], float(t["traffic_split"]), str(t["start_date"]),
             None if t.get("end_date") is None else str(t["end_date"])) for i, t in enumerate(tests)]
    return spark.createDataFrame(rows, TEST_COLUMNS)


def ab_route(requests: DataFrame, tests, *, ts_col: str = "ts", id_col: str = "request_id",
             seed: int | None = None) -> DataFrame:
    """Route each request: B if md5 bucket < split during the first active test
    (in configuration order; ends included), else A; no active test ->
    "default". Requests without an id use ``rand(seed)``. ``tests`` is a list or
    a table of any size: an interval index (``FirstMatch``), joined on time
    buckets."""
    bucket = F.when(F.col(id_col).isNotNull(), fn_hash_md5_bucket(F.col(id_col))).otherwise(F.rand(seed))
    cfg = _tests_table(requests.sparkSession, tests)
    if cfg.schema["rank"].dataType.typeName() == "struct":
        by = Window.orderBy("rank")  # one row per test without a rank of its own
        cfg = cfg.withColumn("rank", F.row_number().over(by))
    micros = lambda c: epoch_micros(F.col(c).cast("timestamp_ntz"))
    index = FirstMatch(cfg.select(micros("start_date").alias("start"), (micros("end_date") + 1).alias("end"), "rank"))
    r = index.lookup(requests.withColumn("random_value", bucket), micros(ts_col), out="_rank")
    chosen = cfg.select(F.col("rank").alias("_rank"), "test_id", "model_a", "model_b", "traffic_split")
    model = (F.when(F.col("test_id").isNull(), F.lit("default"))
             .when(F.col("random_value") < F.col("traffic_split"), F.col("model_b")).otherwise(F.col("model_a")))
    return r.join(chosen, "_rank", "left").withColumn("model_chosen", model).drop("_rank", "model_a", "model_b", "traffic_split")


def agg_routing_stats(routed: DataFrame, tests) -> DataFrame:
    """Per test: totals, A/B counts and shares, expected vs actual split.

    One aggregate over the routed requests, joined to the tests (a list or a
    table of any size)."""
    cfg = tests if isinstance(tests, DataFrame) else routed.sparkSession.createDataFrame(
        [(t["test_id"], t["model_a"], t["model_b"], float(t["traffic_split"])) for t in tests],
        "test_id string, model_a string, model_b string, traffic_split double")
    counts = routed.where(F.col("test_id").isNotNull()).groupBy("test_id", "model_chosen").agg(F.count("*").alias("n"))
    n, a, b = F.col("total_requests"), F.col("model_a_count"), F.col("model_b_count")

    def of(model: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("model_chosen") == F.col(model), F.col("n"))), F.lit(0))

    out = (cfg.join(counts, "test_id", "left").groupBy("test_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests"), of("model_a").alias("model_a_count"),
        of("model_b").alias("model_b_count"), (F.first("traffic_split") * 100).alias("expected_split"))
        .select("test_id", "total_requests", "model_a_count", "model_b_count",
                F.coalesce(F.try_divide(a * 100.0, n), F.lit(0.0)).alias("model_a_percentage"),
                F.coalesce(F.try_divide(b * 100.0, n), F.lit(0.0)).alias("model_b_percentage"), "expected_split"))
    return out.withColumn("actual_split", F.col("model_b_percentage"))


def ab_results(logs: DataFrame, test: dict, *, as_of=None) -> DataFrame:
    """Per success metric: per-arm n / mean / population std, improvement %,
    pooled two-sided t-test (equal variances) and significance."""
    t_end = F.lit(test["end_date"]).cast("timestamp_ntz") if test.get("end_date") else as_of_col(logs, as_of)
    t_start = F.lit(test["start_date"]).cast("timestamp_ntz")
    d = logs.where(F.col("version_id").isin(test["model_a"], test["model_b"]) &
                   F.col("ts").between(t_start, t_end))
    arm = F.when(F.col("version_id") == test["model_a"], F.lit("a")).otherwise(F.lit("b"))
    long = d.select(arm.alias("arm"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.coalesce(F.try_element_at("metrics", F.lit(m)), F.lit(0.0)).alias("v"))
        for m in test["success_metrics"]])).alias("s")).select("arm", "s.*")
    g = long.groupBy("metric").agg(
        F.count_if(F.col("arm") == "a").alias("n_a"), F.count_if(F.col("arm") == "b").alias("n_b"),
        F.avg(F.when(F.col("arm") == "a", F.col("v"))).alias("model_a_mean"),
        F.avg(F.when(F.col("arm") == "b", F.col("v"))).alias("model_b_mean"),
        F.stddev_pop(F.when(F.col("arm") == "a", F.col("v"))).alias("model_a_std"),
        F.stddev_pop(F.when(F.col("arm") == "b", F.col("v"))).alias("model_b_std"),
        F.var_samp(F.when(F.col("arm") == "a", F.col("v"))).alias("_va"),
        F.var_samp(F.when(F.col("arm") == "b", F.col("v"))).alias("_vb"))
    dof = F.col("n_a") + F.col("n_b") - 2
    sp2 = ((F.col("n_a") - 1) * F.col("_va") + (F.col("n_b") - 1) * F.col("_vb")) / dof
    t = (F.col("model_a_mean") - F.col("model_b_mean")) / F.sqrt(sp2 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    g = g.withColumn("improvement", (F.col("model_b_mean") - F.col("model_a_mean")) / F.col("model_a_mean") * 100)
    g = g.withColumn("t_statistic", t).withColumn("dof", dof)
    g = g.withColumn("p_value", t_p_udf(F.col("t_statistic"), F.col("dof").cast("double")))
    return g.withColumn("significant", F.col("p_value") < float(test.get("significance_level", 0.05))) \
        .drop("_va", "_vb")


def ab_recommend(results: DataFrame, test: dict) -> DataFrame:
    """Insufficient sample / deploy B / keep A / no clear winner."""
    g = results.agg(F.count_if(F.col("significant") & (F.col("improvement") > 0)).alias("imp"),
                    F.count_if(F.col("significant") & ~(F.col("improvement") > 0)).alias("deg"),
                    F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"))
    m = int(test["min_sample_size"])
    rec = (F.when((F.col("n_a") < m) | (F.col("n_b") < m), F.lit("Insufficient sample size - continue test"))
           .when(F.col("imp") > F.col("deg"), F.lit("Deploy Model B - shows significant improvement"))
           .when(F.col("deg") > F.col("imp"), F.lit("Keep Model A - Model B shows significant degradation"))
           .otherwise(F.lit("No clear winner - consider business factors or extend test")))
    return g.select(rec.alias("recommendation"), "imp", "deg")


# ------------------------------------------------------------- comparisons

def win_perf_trend(logs: DataFrame, version_id: str, metric: str, *, as_of=None, days: int = 30) -> DataFrame:
    t = as_of_col(logs, as_of)
    d = logs.where((F.col("version_id") == version_id) & (F.col("ts") > t - F.make_dt_interval(F.lit(days)))
                   & F.map_contains_key("metrics", F.lit(metric)))
    return d.select("ts", F.col("metrics")[metric].alias("value")).orderBy("ts")


def ver_compare(logs: DataFrame, versions: list[str], metrics: list[str], *, as_of=None, days: int = 7) -> DataFrame:
    """Per (version, metric): 7-day mean, population std, trend; plus the best
    version per metric (``is_best``)."""
    t = as_of_col(logs, as_of)
    d = logs.where(F.col("version_id").isin(versions) & (F.col("ts") > t - F.make_dt_interval(F.lit(days))))
    long = d.select("version_id", "ts", F.explode("metrics").alias("metric", "value")).where(
        F.col("metric").isin(metrics))
    g = long.groupBy("version_id", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"),
        F.min_by("value", "ts").alias("first_value"), F.max_by("value", "ts").alias("last_value"))
    g = g.withColumn("trend", F.when((F.col("n") > 1) & (F.col("last_value") > F.col("first_value")),
                                     F.lit("improving")).otherwise(F.lit("stable")))
    best = F.max(F.struct("mean", "version_id")).over(Window.partitionBy("metric"))
    return g.withColumn("is_best", best["version_id"] == F.col("version_id")).drop("first_value", "last_value")


def join_registry_logs(registry: DataFrame, logs: DataFrame, *, as_of=None, days: int = 7) -> DataFrame:
    t = as_of_col(logs, as_of)
    recent = logs.where(F.col("ts") > t - F.make_dt_interval(F.lit(days)))
    return registry.join(recent, "version_id")


def ver_model_info(spark, path: str, *, multi_line: bool = False) -> DataFrame:
    """Model info records (JSON lines, or one document per file with
    ``multi_line``) as a table; missing fields -> 'N/A'."""
    schema = ("model_name string, model_type string, test_accuracy double, num_classes long, "
              "training_samples long, classes array<string>")
    d = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    na = F.lit("N/A")
    return d.select(F.coalesce("model_name", na).alias("model_name"), F.coalesce("model_type", na).alias("model_type"),
                    F.coalesce(F.format_number("test_accuracy", 4), na).alias("test_accuracy"),
                    F.coalesce(F.col("num_classes").cast("string"), na).alias("num_classes"),
                    F.coalesce(F.col("training_samples").cast("string"), na).alias("training_samples"))


def join_ab_interval(logs: DataFrame, test: dict, *, as_of=None) -> DataFrame:
    """Log rows of model A or B inside the test's [start, end or as_of] (arm column)."""
    end = F.lit(test["end_date"]).cast("timestamp_ntz") if test.get("end_date") else as_of_col(logs, as_of)
    d = logs.where(F.col("version_id").isin(test["model_a"], test["model_b"])
                   & F.col("ts").between(F.lit(test["start_date"]).cast("timestamp_ntz"), end))
    return d.withColumn("arm", F.when(F.col("version_id") == test["model_a"], F.lit("A")).otherwise(F.lit("B")))
