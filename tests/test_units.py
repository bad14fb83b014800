"""Hand-made fixtures for the statistics, quirks and custom operators."""

import datetime as dt
import hashlib
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F


def test_cooldown_batch(spark):
    from ticketscope.operators.monitor import mon_cooldown
    t0 = dt.datetime(2024, 1, 1)
    rows = [("acc", "m0", t0 + dt.timedelta(minutes=m), 0.5) for m in [0, 30, 59, 61, 100, 125]]
    rows += [("acc", "m1", t0 + dt.timedelta(minutes=m), 0.5) for m in [10, 20]]
    df = spark.createDataFrame(rows, "alert_type string, model_name string, ts timestamp, current_value double")
    kept = mon_cooldown(df, cooldown_minutes=60).where("model_name = 'm0'").orderBy("ts").collect()
    assert [int((r.ts - t0).total_seconds() // 60) for r in kept] == [0, 61, 125]
    assert mon_cooldown(df).where("model_name = 'm1'").count() == 1


def test_cooldown_respects_stored(spark):
    from ticketscope.operators.monitor import mon_cooldown
    t0 = dt.datetime(2024, 1, 1)
    new = spark.createDataFrame([("acc", "m0", t0 + dt.timedelta(minutes=30), 0.5)],
                                "alert_type string, model_name string, ts timestamp, current_value double")
    stored = spark.createDataFrame([("acc", "m0", t0, 0.5)], new.schema)
    assert mon_cooldown(new, stored=stored).count() == 0


def test_txt_clean_cases(spark):
    from ticketscope.functions.text import txt_clean
    rows = [("Visit http://x.com/a NOW!",), ("mail me: a.b@c.org please",), ("call 555-123-4567 today",),
            (None,), ("",), ("Café   déjà  vu",), ("It's   broken\n\tagain",)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(txt_clean("t")).collect()]
    assert out == ["visit now", "mail me please", "call today", "", "", "caf dj vu", "its broken again"]


def test_drift_identical_samples_are_zero(spark):
    from ticketscope.operators.drift import drift_js, drift_ks, drift_psi, drift_wasserstein, melt
    vals = [(float(i % 17), float(i % 5)) for i in range(300)]
    a = spark.createDataFrame(vals, "value double, k double")
    long = melt(a, a, ["value", "k"])
    assert all(abs(r.psi) < 1e-12 for r in drift_psi(long).collect())
    assert all(abs(r.js_divergence) < 1e-12 for r in drift_js(long).collect())
    assert all(abs(r.wasserstein_distance) < 1e-12 for r in drift_wasserstein(long).collect())
    ks = drift_ks(long).collect()
    assert all(r.ks_statistic == 0 and r.p_value == 1.0 for r in ks)


def test_ks_and_w1_against_brute_force(spark):
    from ticketscope.operators.drift import drift_ks, drift_wasserstein, melt
    rnd = random.Random(7)
    ra = [rnd.gauss(0, 1) for _ in range(400)]
    rb = [rnd.gauss(0.3, 1.2) for _ in range(300)]
    a = spark.createDataFrame([(x,) for x in ra], "value double")
    b = spark.createDataFrame([(x,) for x in rb], "value double")
    long = melt(a, b, ["value"])
    xs = sorted(set(ra + rb))
    fa = lambda x: sum(v <= x for v in ra) / len(ra)
    fb = lambda x: sum(v <= x for v in rb) / len(rb)
    d = max(abs(fa(x) - fb(x)) for x in xs)
    w1 = sum(abs(fa(xs[i]) - fb(xs[i])) * (xs[i + 1] - xs[i]) for i in range(len(xs) - 1))
    assert drift_ks(long).collect()[0].ks_statistic == pytest.approx(d)
    assert drift_wasserstein(long).collect()[0].wasserstein_distance == pytest.approx(w1)


def test_running_totals_many_partitions(spark):
    from ticketscope.operators.drift import running_totals
    rows = [(k, float(i), float(i % 3)) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "key string, x double, c double")
    out = running_totals(df, key="key", order="x", cols=["c"], num_partitions=7).toPandas()
    for k, g in out.groupby("key"):
        g = g.sort_values("x")
        assert list(g["cum_c"]) == list(g["c"].cumsum())
        assert list(g["rank"]) == list(range(1, len(g) + 1))


def test_p_value_helpers():
    from ticketscope.functions.stats import chi2_sf, t_two_sided_p
    assert chi2_sf(3.704, 4) == pytest.approx(math.exp(-1.852) * (1 + 1.852), rel=1e-9)
    assert chi2_sf(1.0, 2) == pytest.approx(math.exp(-0.5))
    assert t_two_sided_p(2.0, 10) == pytest.approx(0.0733880347, rel=1e-6)
    assert t_two_sided_p(0.0, 5) == pytest.approx(1.0)


def test_md5_bucket_matches_python(spark):
    from ticketscope.functions.text import fn_hash_md5_bucket
    ids = [str(i) for i in range(2000)] + ["req-abc", "ü", ""]
    got = spark.createDataFrame([(i,) for i in ids], "id string").select("id", fn_hash_md5_bucket("id").alias("b")).collect()
    for r in got:
        assert r.b == (int(hashlib.md5(r.id.encode()).hexdigest(), 16) % 100) / 100.0


def test_ema_multi_block_matches_loop(spark):
    from ticketscope.operators.windows import win_ema
    rnd = random.Random(3)
    vals = [rnd.uniform(0, 100) for _ in range(700)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(vals)], "g string, i long, v double")
    out = win_ema(df, value="v", group="g", order=["i"], alpha=0.1, block=16).orderBy("i").toPandas()
    e, ref = None, []
    for v in vals:
        e = v if e is None else 0.9 * e + 0.1 * v
        ref.append(e)
    assert max(abs(a - b) for a, b in zip(out["ema"], ref)) < 1e-9


def test_vote_ties_alphabetical_and_scores_sum_to_one(spark):
    from ticketscope.operators.ensemble import ens_class_scores, ens_weighted_vote
    votes = spark.createDataFrame([(1, "a", "Zeta", 0.6), (1, "b", "Alpha", 0.6), (2, "a", "X", 0.9)],
                                  "text_id long, model string, prediction string, confidence double")
    r = {x.text_id: x for x in ens_weighted_vote(votes).collect()}
    assert r[1].ensemble_prediction == "Alpha" and r[1].agreement_score == 0.5
    assert r[2].agreement_score == 1.0 and r[2].ensemble_confidence == pytest.approx(1.0)
    sums = ens_class_scores(votes).groupBy("text_id").agg(F.sum("score").alias("s")).collect()
    assert all(x.s == pytest.approx(1.0) for x in sums)


def test_decode_messages_errors(spark):
    from ticketscope.streaming.jobs import decode_messages
    msgs = [(1, '{"customer_message": "hi", "unknown": 3}'), (2, '{"ticket_id": "t2"}'), (3, "{not json"),
            (4, '{"ticket_id": "x", "customer_message": "m", "priority": "high"}')]
    df = spark.createDataFrame(msgs, "offset long, value string")
    r = {x.offset: x for x in decode_messages(df).collect()}
    assert r[1].ticket_id == "kafka_1" and r[1].priority == "medium" and r[1].error is None
    assert r[2].error.startswith("Missing required field")
    assert r[3].error == "Invalid JSON format"
    assert r[4].priority == "high" and r[4].channel == "kafka"


def test_pareto_matches_brute_force(spark):
    from ticketscope.operators.ml import join_pareto_dominance
    rnd = random.Random(11)
    pts = [(i, float(rnd.randint(0, 20)), float(rnd.randint(0, 20)), float(rnd.randint(0, 20))) for i in range(300)]
    df = spark.createDataFrame(pts, "trial long, obj1 double, obj2 double, obj3 double").repartition(5)
    got = {r.trial for r in join_pareto_dominance(df, ["obj1", "obj2", "obj3"]).collect()}

    def dom(a, b):
        return all(x >= y for x, y in zip(a[1:], b[1:])) and any(x > y for x, y in zip(a[1:], b[1:]))

    want = {p[0] for p in pts if not any(dom(q, p) for q in pts)}
    assert got == want


def test_template_fallbacks(spark):
    from ticketscope.operators.responses import rsp_template, templates_df
    t = spark.createDataFrame([(1, "Billing", "HIGH", "Ann"), (2, "Unknown", "low", None), (3, "Unknown", "weird", "B")],
                              "id long, category string, urgency string, customer_name string")
    r = {x.id: x.template_used for x in rsp_template(t, templates_df(spark)).collect()}
    assert r == {1: "billing_high", 2: "general_low", 3: "general_medium"}


def test_custom_template_variables(spark):
    from ticketscope.operators.responses import rsp_template, templates_df
    custom = spark.createDataFrame([("billing", "low", "Hi {customer_name}, about {account_id}.", None)],
                                   "category string, urgency string, template string, tone string")
    t = spark.createDataFrame([(1, "billing", "low", "Ann")], "id long, category string, urgency string, customer_name string")
    row = rsp_template(t, templates_df(spark, custom)).collect()[0]
    assert row.response_text == "Hi Ann, about your account."


def test_stratified_split_proportions(spark):
    from ticketscope.operators.features import txt_stratified_split
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "id long, label string")
    c = {(r.label, r.split): r["count"] for r in
         txt_stratified_split(df, id_col="id", label_col="label").groupBy("label", "split").count().collect()}
    assert c[("a", "test")] == 40 and c[("a", "val")] == 20 and c[("b", "test")] == 20 and c[("b", "val")] == 10


def test_gdpr_or_join_uses_email_identity(spark):
    from ticketscope.operators.audit import aud_gdpr_counts, join_gdpr_erase
    ev = spark.createDataFrame([(1, "u1"), (2, "mail@x"), (3, "u2"), (4, None)], "event_id long, user_id string")
    req = spark.createDataFrame([("r1", "deletion", "u1", "mail@x")],
                                "request_id string, request_type string, user_id string, email string")
    assert aud_gdpr_counts(ev, req).collect()[0].total_events == 2
    assert sorted(r.event_id for r in join_gdpr_erase(ev, req).collect()) == [3, 4]


def test_nb_incremental_scores(spark):
    from ticketscope.streaming.jobs import nb_counts, ol_incremental_model
    fb = spark.createDataFrame([("refund my payment", "Billing"), ("payment charge wrong", "Billing"),
                                ("app crash error", "Tech"), ("error on login crash", "Tech")],
                               "text string, true_category string")
    docs = spark.createDataFrame([(1, "payment refund"), (2, "crash error")], "id long, text string")
    r = {x.doc_id: x.predicted_category for x in ol_incremental_model(nb_counts(fb), docs, id_col="id", text_col="text").collect()}
    assert r == {1: "Billing", 2: "Tech"}


@pytest.mark.parametrize("chunk", ["10000", "2"])
def test_streaming_cooldown_state(spark, tmp_path, chunk):
    """Also with a key's alerts spread over several unordered Arrow chunks."""
    from ticketscope.streaming.jobs import st_alert_cooldown
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("acc", "m0", t0 + dt.timedelta(minutes=m), 0.1) for m in [100, 0, 61, 30, 125, 59]]
    df = spark.createDataFrame(rows, "alert_type string, model_name string, ts timestamp, current_value double").coalesce(1)
    df.write.parquet(str(tmp_path / "alerts"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "alerts"))
    q = (st_alert_cooldown(src).writeStream.format("memory").queryName(f"kept_test_{chunk}").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    mins = sorted(int((r.ts - t0).total_seconds() // 60) for r in spark.sql(f"select ts from kept_test_{chunk}").collect())
    assert mins == [0, 61, 125]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_running_totals_across_arrow_batches(spark):
    from ticketscope.operators.drift import running_totals
    rows = [(k, float(i), float(i % 4)) for k in ("a", "b", "c") for i in range(300)]
    df = spark.createDataFrame(rows, "key string, x double, c double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        out = running_totals(df, key="key", order="x", cols=["c"], num_partitions=3).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for k, g in out.groupby("key"):
        g = g.sort_values("x")
        assert list(g["cum_c"]) == list(g["c"].cumsum())
        assert list(g["rank"]) == list(range(1, len(g) + 1))


def test_validate_schema_and_missing_columns(spark, tmp_path):
    from ticketscope.sources.files import SchemaError, src_csv_tickets, src_validate_schema
    ok = spark.createDataFrame([("hi", None)], "customer_message string, category string")
    r = src_validate_schema(ok).collect()[0]
    assert (r.is_valid, r.message) == (False, "Column 'category' is completely empty")
    bad = spark.createDataFrame([("hi",)], "customer_message string")
    assert src_validate_schema(bad).collect()[0].message == "Missing required columns: category"
    p = str(tmp_path / "t.csv")
    with open(p, "w") as f:
        f.write("ticket_id,customer_message\n1,hello\n")
    with pytest.raises(SchemaError):
        src_csv_tickets(spark, p)


def test_clean_generated_and_quality(spark):
    from ticketscope.operators.responses import fn_clean_generated, rsp_quality
    df = spark.createDataFrame([("hello [x] world (y) <b>now</b>", "General"),
                                ("we are sorry, thank you", "complaint")], "t string, c string")
    r = df.select(fn_clean_generated(F.col("t")).alias("x"), rsp_quality(F.col("t"), F.col("c")).alias("q")).collect()
    assert r[0].x == "Hello world now."
    assert r[1].q == pytest.approx(0.5 + 0.05 + 0.1)


def test_confidence_boost_and_primary_modality(spark):
    from ticketscope.operators.modal import mm_classify
    df = spark.createDataFrame([(1, "text", 1.0, 0.9, 0.5, None, "Billing", 0.7), (2, None, None, 0.2, None, None, None, None)],
                               "id long, text string, t double, i double, a double, d double, pred string, conf double")
    r = {x.id: x for x in mm_classify(df, {"text": "t", "images": "i", "audio": "a", "documents": "d"},
                                      prediction_col="pred", confidence_col="conf").collect()}
    assert r[1].confidence == pytest.approx(0.9) and r[1].primary_modality == "text"
    assert r[2].predicted_category == "General Inquiry" and r[2].confidence == pytest.approx(0.1)
    assert r[2].primary_modality == "images"


def test_next_version_ignores_bad_versions(spark):
    from ticketscope.operators.versions import win_next_version
    reg = spark.createDataFrame([("a", "1.2.3"), ("a", "1.10.0"), ("a", "x.y"), ("b", "beta")],
                                "model_name string, version string")
    r = {x.model_name: x.next_version for x in win_next_version(reg).collect()}
    assert r == {"a": "1.10.1", "b": "1.0.0"}


def test_ab_results_t_test(spark):
    from ticketscope.operators.versions import ab_results
    rows = [("A", dt.datetime(2024, 1, 2), {"m": float(v)}) for v in [1, 2, 3, 4, 5]]
    rows += [("B", dt.datetime(2024, 1, 2), {"m": float(v)}) for v in [3, 4, 5, 6, 7]]
    logs = spark.createDataFrame(rows, "version_id string, ts timestamp_ntz, metrics map<string,double>")
    test = {"model_a": "A", "model_b": "B", "start_date": "2024-01-01", "end_date": "2024-01-03",
            "success_metrics": ["m"], "significance_level": 0.05}
    r = ab_results(logs, test).collect()[0]
    assert r.t_statistic == pytest.approx(-2.0)
    assert r.p_value == pytest.approx(0.0805, abs=1e-3)
    assert r.improvement == pytest.approx(66.6667, abs=1e-3)


def test_constant_feature_psi_and_histogram(spark):
    from ticketscope.operators.aggs import agg_conf_histogram
    from ticketscope.operators.drift import drift_js, drift_psi, melt
    a = spark.createDataFrame([(5.0,)] * 20, "value double")
    b = spark.createDataFrame([(5.0,)] * 7, "value double")
    long = melt(a, b, ["value"])
    assert drift_psi(long).collect()[0].psi == pytest.approx(0.0, abs=1e-12)
    assert drift_js(long).collect()[0].js_divergence == pytest.approx(0.0, abs=1e-12)
    h = agg_conf_histogram(a.withColumnRenamed("value", "confidence"), 20).collect()
    assert len(h) == 20 and sum(r["count"] for r in h) == 20


def test_retention_rule_day_boundary(spark):
    from ticketscope.operators.audit import aud_rule_eval
    t0 = dt.datetime(2024, 1, 31)
    ev = spark.createDataFrame([(1, t0 - dt.timedelta(days=15, hours=23), "access", None),
                                (2, t0 - dt.timedelta(days=16), "access", None),
                                (3, t0, "prediction", 0.2)],
                               "event_id long, ts timestamp_ntz, event_type string, confidence double")
    rules = [{"rule_id": "r", "rule_type": "retention", "severity": "high", "retention_days": 15},
             {"rule_id": "b", "rule_type": "bias", "severity": "high", "confidence_floor": 0.5}]
    v = {(r.rule_id, r.event_id) for r in aud_rule_eval(ev, rules, as_of=t0).collect()}
    assert v == {("r", 2), ("b", 3)}


def test_event_build_all_kinds(spark):
    from ticketscope.operators.audit import prj_event_build
    t = dt.datetime(2024, 1, 1)
    tr = spark.createDataFrame([(t, "m1", "u1", {"rows": "10"}, {"C": "1.0"}, {"acc": "0.9"})],
                               "ts timestamp_ntz, model_id string, user_id string, dataset_info map<string,string>, "
                               "params map<string,string>, results map<string,string>")
    r = prj_event_build(tr, kind="training").collect()[0]
    assert r.event_type == "training" and r.compliance_tags == ["training", "model_creation"]
    assert r.data_lineage.source_type == "training_data" and r.output_data["results"] == '{"acc":"0.9"}'
    up = spark.createDataFrame([(t, "m1", None, "retrain", {"v": "2"})],
                               "ts timestamp_ntz, model_id string, user_id string, update_type string, changes map<string,string>")
    r = prj_event_build(up, kind="model_update").collect()[0]
    assert r.compliance_tags == ["model_modification"] and r.data_lineage is None and r.user_id is None
    ac = spark.createDataFrame([(t, "m1", "u2", "read")], "ts timestamp_ntz, model_id string, user_id string, access_type string")
    r = prj_event_build(ac, kind="access").collect()[0]
    assert r.input_data_hash == "" and r.output_data == {"access_type": "read"}


def test_text_attachments_encodings(spark, tmp_path):
    from ticketscope.sources.files import src_text_attachments
    d = tmp_path / "t1"
    d.mkdir()
    (d / "a.txt").write_bytes("  héllo utf8  \n".encode("utf-8"))
    (d / "b.log").write_bytes("caf\xe9 latin".encode("latin-1"))
    (d / "c.pdf").write_bytes(b"%PDF-1.4")
    r = src_text_attachments(spark, str(tmp_path) + "/*/*").collect()[0]
    assert r.ticket_id == "t1" and r.processed_count == 2
    assert r.extracted_text == "héllo utf8\n\ncafé latin"
    assert r.confidence == pytest.approx(0.9)


def test_response_fallback_row(spark):
    from ticketscope.operators.responses import rsp_generate, templates_df
    t = spark.createDataFrame([(1, None, "low", 0.9, "Ann", "msg"), (2, "complaint", "medium", 0.9, "Bo", "x" * 150)],
                              "id long, category string, urgency string, confidence double, customer_name string, text string")
    r = {x.id: x for x in rsp_generate(t, templates_df(spark)).collect()}
    assert r[1].template_used == "fallback" and r[1].escalation_recommended
    assert r[1].response_text.startswith("Thank you for contacting us, Ann. We have received your general inquiry")
    assert r[2].template_used == "complaint_medium" and r[2].escalation_recommended
    assert r[2].original_ticket == "x" * 100 + "..."


def test_retrain_strategy_needs_50(spark):
    from ticketscope.operators.learning import al_retrain_strategy
    few = spark.createDataFrame([("a", "b")] * 10, "predicted_category string, true_category string")
    r = al_retrain_strategy(few).collect()[0]
    assert not r.should_retrain and r.strategies == ""
    many = spark.createDataFrame([("a", "b")] * 40 + [("a", "a")] * 20, "predicted_category string, true_category string")
    r = al_retrain_strategy(many).collect()[0]
    assert r.should_retrain and "focused_retraining: Focus on distinguishing a from b" in r.strategies
    assert "general_retraining" in r.strategies


def test_bias_substring_semantics(spark):
    from ticketscope.operators.explain import ex_bias_parity
    df = spark.createDataFrame([("the bill", "Billing"), ("login error", "Tech"), ("other text", "Tech")],
                               "text string, label string")
    b = {(r.attribute, r.label): r for r in ex_bias_parity(df, text_col="text", label_col="label",
                                                          attributes={"gender": ["he"]}).collect()}
    # "he" is a substring of "the" and "other": two texts carry the attribute
    assert b[("gender", "Billing")].n_with == 1 and b[("gender", "Tech")].n_with == 1
    assert b[("gender", "Tech")].n_without == 1


def test_rollback_none_when_deployed_is_oldest(spark):
    from ticketscope.operators.versions import win_rollback_target
    reg = spark.createDataFrame([("m", "1.0.0", dt.datetime(2024, 1, 1)), ("m", "1.0.1", dt.datetime(2024, 1, 2)),
                                 ("m", "1.0.2", dt.datetime(2024, 1, 3))],
                                "model_name string, version string, creation_date timestamp_ntz")
    dep = spark.createDataFrame([("m", "1.0.0")], "model_name string, version string")
    assert win_rollback_target(reg, dep).count() == 0
    dep2 = spark.createDataFrame([("m", "1.0.1")], "model_name string, version string")
    assert win_rollback_target(reg, dep2).collect()[0].version == "1.0.0"


def test_stream_dedupe_within_watermark(spark, tmp_path):
    from ticketscope.streaming.jobs import st_dedupe_late
    t0 = dt.datetime(2024, 1, 1)
    rows = [("t1", t0), ("t1", t0 + dt.timedelta(minutes=10)), ("t2", t0 + dt.timedelta(minutes=5))]
    df = spark.createDataFrame(rows, "ticket_id string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (st_dedupe_late(src, key=["ticket_id"]).writeStream.format("memory").queryName("dedupe_test")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(r.ticket_id for r in spark.sql("select ticket_id from dedupe_test").collect())
    assert got == ["t1", "t2"]


def test_periodic_checks_match_direct_windows(spark):
    """Bucket range frames == filtering the raw log at every check time."""
    from ticketscope.operators.monitor import mon_degradation_checks
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        ts = t0 + dt.timedelta(seconds=rnd.randint(0, 3 * 86400))
        late = ts > t0 + dt.timedelta(days=2)
        conf = rnd.uniform(0.1, 0.5) if late else rnd.uniform(0.5, 1.0)
        pred = "Error" if (late and rnd.random() < 0.3) else "a"
        rows.append((i, ts, "m", pred, conf, rnd.uniform(10, 20), None if i % 3 else pred == "a"))
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, model_name string, predicted_class string, "
                                     "confidence double, latency_ms double, is_correct boolean")
    got = {(r.ts, r.alert_type): r.current_value for r in mon_degradation_checks(df).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "ts", "model_name", "pred", "conf", "lat", "ok"])
    step = dt.timedelta(minutes=10)
    want = {}
    check = t0 + step
    while check <= t0 + dt.timedelta(days=3, hours=1):
        cur = pdf[(pdf.ts > check - dt.timedelta(hours=1)) & (pdf.ts <= check)]
        base = pdf[(pdf.ts > check - dt.timedelta(hours=25)) & (pdf.ts <= check - dt.timedelta(hours=1))]
        if len(cur) and len(base):
            snap = lambda v: round(v * 2 ** 20) / 2 ** 20  # noqa: E731  (operator snaps before thresholds)
            drop = snap(base.conf.mean()) - snap(cur.conf.mean())
            if drop > 0.1:
                want[(check, "confidence_degradation")] = cur.conf.mean()
            err = snap((cur.pred == "Error").mean()) - snap((base.pred == "Error").mean())
            if err > 0.02:
                want[(check, "error_rate_increase")] = (cur.pred == "Error").mean()
        check += step
    got_sub = {k: v for k, v in got.items() if k[1] in ("confidence_degradation", "error_rate_increase")}
    assert set(got_sub) == set(want)
    assert all(abs(got_sub[k] - want[k]) < 1e-6 for k in want)


def test_svm_scores_and_unseen_categories(spark):
    """Margins become probabilities; scoring needs no known category; the grid reaches the inner machine."""
    from ticketscope.operators import ml
    words = {"Billing": "invoice refund payment", "Technical": "error crash broken"}
    rows = [(i, f"{words[c]} number{i % 3}", c) for i, c in enumerate(["Billing", "Technical"] * 10)]
    df = spark.createDataFrame(rows, "ticket_id long, customer_message string, category string")
    model = ml.ml_train_pipeline(df, model_type="linear_svm", maxIter=5)
    new = spark.createDataFrame([(1, "refund the invoice", "Never seen"), (2, "crash error", None), (3, "", None)],
                                "ticket_id long, customer_message string, category string")
    got = {r.ticket_id: r for r in ml.ml_predict_batch(model, new).collect()}
    assert got[1].predicted_category == "Billing" and got[2].predicted_category == "Technical"
    assert all(abs(sum(got[i].probabilities.values()) - 1) < 1e-9 and got[i].confidence > 0.5 for i in (1, 2))
    assert got[3].predicted_category == "General Inquiry" and got[3].confidence == 0.0
    with pytest.raises(ValueError):
        ml.spark_params("svm", {"kernel": "rbf"})


def test_counterfactuals_try_every_word(spark):
    """The first three hits of a text, wherever its class flips."""
    from ticketscope.operators.explain import ex_counterfactual, join_counterfactual_cand

    class Model:  # flips where one of the words from position 4 on is replaced by "k1" or "k2"
        def transform(self, df):
            hit = F.expr("exists(slice(split(candidate, ' '), 5, 100), x -> x in ('k1', 'k2'))") | F.col("candidate").endswith("p1")
            return df.withColumn("predicted_category", F.when(hit, F.lit("A"))).withColumn("confidence", F.lit(0.5))

    lexicon = spark.createDataFrame([("A", "keyword", i, f"k{i}") for i in range(1, 8)] + [("A", "phrase", i, f"p{i}") for i in (1, 2, 3)],
                                    "class string, kind string, rank int, term string")
    df = spark.createDataFrame([(1, "a b c d e f g", "A"), (2, "a b c", "A"), (3, "a b c d e", "A"), (4, None, "A")],
                               "id long, text string, target string")
    cand = join_counterfactual_cand(df, lexicon, id_col="id", text_col="text", target_col="target")
    assert cand.where("id = 1 and change_type = 'word_replacement'").count() == 7 * 5
    got = ex_counterfactual(cand, Model(), id_col="id", target_col="target").collect()
    assert sorted((r.id, r.candidate) for r in got if r.change_type == "word_replacement") == [
        (1, "a b c d e k1 g"), (1, "a b c d k1 f g"), (1, "a b c d k2 f g"), (3, "a b c d k1"), (3, "a b c d k2")]
    assert sorted((r.id, r.candidate) for r in got if r.change_type == "phrase_addition" and r.id < 4) == [
        (1, "a b c d e f g p1"), (2, "a b c p1"), (3, "a b c d e p1")]


def test_attachments_of_a_folder(spark, tmp_path):
    from ticketscope.sources.files import src_text_attachments
    for k in ("t1", "t2"):
        (tmp_path / "deep" / k).mkdir(parents=True)
        (tmp_path / "deep" / k / "a.txt").write_text(f" text of {k}\n")
    got = {r.ticket_id: r.extracted_text for r in src_text_attachments(spark, str(tmp_path)).collect()}
    assert got == {"t1": "text of t1", "t2": "text of t2"}


def test_rollback_joins_each_entry_once(spark):
    from pyspark.sql import functions as F

    from ticketscope.operators.versions import win_rollback_target
    reg = spark.range(300).select(F.lit("a").alias("model_name"), (F.col("id") % 3).cast("string").alias("version"),
                                  F.timestamp_seconds("id").alias("creation_date"))
    deployed = spark.createDataFrame([("a", "2")], "model_name string, version string")
    out = win_rollback_target(reg, deployed)
    r = out.collect()[0]
    assert (r.version, r.creation_date.timestamp(), r.deployed_created.timestamp()) == ("1", 298.0, 299.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") < plan.rindex("Join")  # one entry per deployed version meets the registry


def test_classifier_reads_vectors_and_labels_only(spark, monkeypatch):
    from ticketscope.operators import ml
    seen, real = [], ml.make_classifier

    class Spy:
        def __init__(self, *a, **k):
            self.own = real(*a, **k)

        def fit(self, df):
            seen.append(sorted(df.columns))
            return self.own.fit(df)

    monkeypatch.setattr(ml, "make_classifier", Spy)
    df = spark.createDataFrame([(i, ("refund money", "login error")[i % 2], "ab"[i % 2]) for i in range(8)],
                               "ticket_id long, customer_message string, category string")
    ml.ml_train_pipeline(df, maxIter=2)
    assert seen == [["features", "label"]]
