"""Stream state: both triggers of a batch, running statistics, the listener, a fitted model."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from ticketscope.streaming.stateful import StreamStats, st_count_or_timeout, st_running_stats

SCHEMA = "k string, i int"


def drop(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def wait(until, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if until():
            return True
        time.sleep(0.3)
    return False


def test_batches_fire_by_count_and_by_timeout(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    drop(spark, src, [("a", i) for i in range(23)] + [("b", i) for i in range(4)])
    got = []

    def take(batch, batch_id):
        got.extend(batch.collect())

    stream = st_count_or_timeout(spark.readStream.schema(SCHEMA).parquet(src), key="k", size=10, timeout_seconds=2, order=["i"])
    q = (stream.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", out)
         .trigger(processingTime="300 milliseconds").start())
    try:
        assert wait(lambda: sum(r.n for r in got) == 27)
        batches = {(r.key, r.batch_no): (r.fired, [json.loads(x)["i"] for x in r.rows]) for r in got}
        assert batches == {("a", 0): ("count", list(range(10))), ("a", 1): ("count", list(range(10, 20))),
                           ("a", 2): ("timeout", [20, 21, 22]), ("b", 0): ("timeout", [0, 1, 2, 3])}
        drop(spark, src, [("a", i) for i in range(100, 110)])  # a full batch needs no timer
        assert wait(lambda: len(got) == 5) and (got[-1].fired, got[-1].batch_no, got[-1].n) == ("count", 3, 10)
    finally:
        q.stop()


def test_open_batch_survives_a_restart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "ckpt")
    got = []
    for part in ([("a", i) for i in range(6)], [("a", i) for i in range(6, 11)]):
        drop(spark, src, part)
        q = (st_count_or_timeout(spark.readStream.schema(SCHEMA).parquet(src), key="k", size=10, timeout_seconds=None)
             .writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", out).trigger(availableNow=True).start())
        q.awaitTermination()
    assert [(r.fired, r.n) for r in got] == [("count", 10)]


def test_running_stats_over_micro_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    kind = "k string, ts timestamp, processing_time_ms double, is_error boolean"
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    parts = [[("a", t(1), 20.0, False), ("a", t(0), 10.0, True)], [("a", t(5), 30.0, None), ("b", t(2), 5.0, False)]]
    got = []
    for part in parts:
        drop(spark, src, part, kind)
        q = (st_running_stats(spark.readStream.schema(kind).parquet(src), key="k").writeStream.outputMode("update")
             .foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
        q.awaitTermination()
    last = {r.key: r for r in got}
    assert (last["a"].total_processed, last["a"].total_errors, last["a"].uptime_seconds) == (3, 1, 5.0)
    assert last["a"].avg_processing_time_ms == pytest.approx(0.9 * (0.9 * 10 + 0.1 * 20) + 0.1 * 30)
    assert last["a"].throughput_per_second == pytest.approx(3 / 5) and last["b"].throughput_per_second is None


def test_listener_adds_up_observed_metrics(spark, tmp_path):
    src = str(tmp_path / "in")
    for n in (7, 5):
        drop(spark, src, [("a" if i % 2 else "bad", i) for i in range(n)])
    stats = StreamStats()
    spark.streams.addListener(stats)
    try:
        s = StreamStats.watched(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), F.col("k") == "bad")
        q = s.writeStream.foreachBatch(lambda b, _: b.count()).queryName("watched").option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert wait(lambda: stats.stats() and not stats.stats()[0]["is_running"])
        (x,) = stats.stats()
        assert (x["name"], x["batches"], x["total_processed"], x["total_errors"]) == ("watched", 2, 12, 7)
        assert x["avg_processing_time_ms"] > 0 and x["uptime_seconds"] > 0 and x["throughput_per_second"] > 0
        assert stats.table(spark).first().total_processed == 12
    finally:
        spark.streams.removeListener(stats)


def test_fitted_model_in_the_stream_scores_like_the_batch(spark, tmp_path):
    from ticketscope.operators import ml
    from ticketscope.streaming.jobs import run_classification_stream
    words = {"Billing": "invoice refund payment", "Technical": "error crash broken"}
    rows = [(i, f"{words[c]} number{i % 3}", c, dt.datetime(2024, 1, 1, 0, i)) for i, c in enumerate(["Billing", "Technical"] * 10)]
    df = spark.createDataFrame(rows, "ticket_id long, customer_message string, category string, ts timestamp")
    model = ml.ml_train_pipeline(df, model_type="logistic_regression")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)

    def scorer(d):
        return ml.ml_predict_batch(model, d, with_prob_columns=False).select(
            "ticket_id", "ts", "predicted_category", "confidence", F.lit(1.0).alias("processing_time_ms"))

    q = run_classification_stream(spark, spark.readStream.schema(df.schema).parquet(src), scorer, out_path=str(tmp_path / "out"),
                                  checkpoint=str(tmp_path / "c"), order=["ts", "ticket_id"])
    q.awaitTermination()
    got = {r.ticket_id: (r.predicted_category, r.confidence) for r in spark.read.parquet(os.path.join(str(tmp_path / "out"), "results")).collect()}
    want = {r.ticket_id: (r.predicted_category, r.confidence) for r in ml.ml_predict_batch(model, df, with_prob_columns=False).collect()}
    assert got == want


def test_last_rows_of_a_batch_are_flagged_without_ranking_it(spark):
    from ticketscope.streaming.jobs import flag_drift_of_batch
    rows = spark.range(40).select(F.col("id"), (F.col("id") % 7).alias("ts"), F.monotonically_increasing_id().alias("_rid")).persist()
    for drift in (True, False, None):
        mon = spark.createDataFrame([(drift,)], "drift_detected boolean")
        got = {r.id for r in flag_drift_of_batch(rows, mon, order=["ts", "id"]).where("drift_detected").collect()}
        assert got == ({34, 27, 20, 13, 6} if drift else set())
    plan = flag_drift_of_batch(rows, mon, order=["ts"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("files", [1, 4])
def test_feedback_updates_follow_the_buffer(spark, tmp_path, files):
    from ticketscope.streaming.stateful import st_feedback_buffer
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    n = 87
    cuts = [n * i // files for i in range(files + 1)]
    for a, b in zip(cuts, cuts[1:]):
        drop(spark, src, [("a", i) for i in range(a, b)] + [("b", i) for i in range(a // 3, b // 3)])
        time.sleep(1.1)  # the file source reads by modification time
    stream = st_feedback_buffer(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), key="k", order=["i"])
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.update_no: ([json.loads(x)["i"] for x in r.batch], [json.loads(x)["i"] for x in r.recent], r.key)
           for r in spark.read.schema(stream.schema).parquet(out).collect()}
    # key a: due at 50, 60, 70 and 80 rows; key b never has 50
    assert got == {u: (list(range(u * 10, u * 10 + 10)), list(range(u * 10, u * 10 + 50)), "a") for u in range(4)}


def test_refit_counts_documents_without_tokens(spark):
    from ticketscope.streaming.stateful import nb_refits
    rows = [json.dumps({"text": "Ab ab", "true_category": "x"}), json.dumps({"text": None, "true_category": "y"})]
    up = spark.createDataFrame([("a", 0, [], rows)], "key string, update_no long, batch array<string>, recent array<string>")
    got = {(r["class"], r.term): r.n for r in nb_refits(up, "text string, true_category string").collect()}
    assert got == {("x", "ab"): 2, ("x", ""): 1, ("y", ""): 1}


def test_documents_without_tokens_get_the_prior(spark):
    from ticketscope.streaming.jobs import nb_counts, ol_incremental_model
    fb = spark.createDataFrame([("ab cd", "x"), ("", "y"), (None, "y")], "text string, true_category string")
    docs = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id long, text string")
    got = {r.doc_id: r.predicted_category for r in ol_incremental_model(nb_counts(fb), docs, id_col="id", text_col="text").collect()}
    assert got[2] == got[3] == "y" and set(got) == {1, 2, 3}
