"""Reports over few rows: class report, retention, lemmas, bias of own attributes, last responses, fitted modal classifier."""

import datetime as dt

import pytest
from pyspark.sql import functions as F


def test_class_report_with_missing_classes(spark):
    from ticketscope.operators.ml import ev_class_report
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", None), (None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "true_category string, predicted_category string")
    got = {r["class"]: r for r in ev_class_report(df).collect()}
    assert set(got) == {"a", "b", "c", None, "macro avg", "weighted avg"}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.5, 0.5, 2)
    assert (got["b"].precision, got["b"].recall) == (0.5, 1.0)
    assert (got["c"].precision, got["c"].recall, got["c"].f1) == (0.0, 0.0, 0.0)
    assert got["macro avg"].recall == pytest.approx(1.5 / 4) and got["macro avg"].support == 6
    assert got["weighted avg"].recall == pytest.approx(2 / 6)


def test_retention_of_events_and_violations(spark):
    from ticketscope.operators.audit import aud_retention_purge
    day = dt.datetime(2024, 1, 31)
    ev = spark.createDataFrame([(1, day), (2, day - dt.timedelta(days=20)), (3, None)], "event_id long, ts timestamp_ntz")
    vi = spark.createDataFrame([("v", day - dt.timedelta(days=16)), ("w", day - dt.timedelta(days=15))], "violation_id string, ts timestamp_ntz")
    none = spark.createDataFrame([], "id string, ts timestamp_ntz")
    kept, counts = aud_retention_purge({"events": ev, "violations": vi, "other": none}, retention_days=15)
    assert {r.source: (r.deleted_count, r.kept_count) for r in counts.collect()} == {
        "events": (1, 2), "violations": (1, 1), "other": (0, 0), "total": (2, 3)}
    assert sorted(r.event_id for r in kept["events"].collect()) == [1, 3]
    assert [r.violation_id for r in kept["violations"].collect()] == ["w"]


def test_lemmas_of_repeated_and_null_ids(spark):
    from ticketscope.operators.textproc import txt_lemma
    lem = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("dogs", "hound")], "word string, lemma string")
    rows = [(1, "cats dogs"), (1, "cats dogs"), (1, "dogs x"), (None, "cats"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = sorted((str(r.id), r.lemmatized) for r in txt_lemma(df, "t", lem, id_col="id").collect())
    assert got == sorted([("1", "cat dog"), ("1", "cat dog"), ("1", "dog x"), ("None", "cat"), ("2", ""), ("3", "")])
    with pytest.raises(ValueError):
        txt_lemma(df, "t", lem)


def test_bias_pivot_over_own_attributes(spark):
    from ticketscope.operators.explain import ex_bias_parity, ex_bias_pivot
    df = spark.createDataFrame([("vip now", "a"), ("hello", "b"), ("vip", "b"), ("x", "b")], "text string, label string")
    own = {"tier": ["vip"], "region": ["nowhere"]}
    got = {r.label: r for r in ex_bias_pivot(ex_bias_parity(df, text_col="text", label_col="label", attributes=own), own).collect()}
    assert got["a"].tier == 0.5 and got["b"].tier == -0.5 and got["a"].region == 0.0
    assert set(got["a"].asDict()) == {"label", "tier", "region"}


def test_last_responses(spark):
    from ticketscope.operators.responses import agg_response_recent
    df = spark.range(25).select(F.col("id").alias("at"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("response_text"))
    got = agg_response_recent(df, ["at"]).collect()
    assert sorted((r.recency, r.at, r.response_length) for r in got) == [(i + 1, 24 - i, 24 - i) for i in range(10)]


def test_fitted_model_over_joined_modalities(spark):
    from ticketscope.operators import ml
    from ticketscope.operators.modal import mm_classify_model
    train = spark.createDataFrame([("invoice payment charge", "Billing"), ("crash error bug", "Technical Issue")] * 10,
                                  "customer_message string, category string")
    model = ml.ml_train_pipeline(train)
    rows = [(1, "payment", None, 1.0, None), (2, None, "crash bug", None, 0.9), (3, None, None, None, 0.9), (4, "error", "bug", 1.0, 0.9)]
    df = spark.createDataFrame(rows, "id long, message string, image_text string, tc double, ic double")
    got = {r.id: r for r in mm_classify_model(df, model, {"text": "tc", "images": "ic"}, text_cols=["message", "image_text"]).collect()}
    assert [got[i].predicted_category for i in (1, 2, 3, 4)] == ["Billing", "Technical Issue", "General Inquiry", "Technical Issue"]
    assert got[3].confidence == pytest.approx(0.1) and got[4].confidence == pytest.approx(min(1.0, got[4].base_confidence + 0.1))
    assert got[2].primary_modality == "images"
