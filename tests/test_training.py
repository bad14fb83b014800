"""The training job: split, fit, evaluation on unseen texts, saved model; vectors for cross-validation."""

import json

import pytest
from pyspark.ml import PipelineModel


def tickets(spark, n=60):
    """Every text holds its class's word and a word of its own: classes can be learned, own words cannot."""
    rows = [(None if k == 0 else k // 2, f"{('refund', 'crash')[k % 2]} own{chr(97 + k // 26)}{chr(97 + k % 26)}", "ab"[k % 2])
            for k in range(n)]
    rows += [(1000, "", "a"), (1001, None, "b"), (1002, "refund nobody", None)]
    return spark.createDataFrame(rows, "ticket_id long, customer_message string, category string")


def test_training_job_holds_out_its_test_texts(spark, tmp_path):
    from ticketscope.operators import ml as ML
    got = ML.ml_train_job(tickets(spark), str(tmp_path), id_col="ticket_id").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.n, r.training_samples, r.validation_samples) == (12, 42, 6) and r.accuracy == 1.0
    assert r.label_mapping == ["a", "b"]
    assert {c["class"]: c.support for c in r.classification_report} == {"a": 6, "b": 6, "macro avg": 12, "weighted avg": 12}
    model = PipelineModel.load(f"{tmp_path}/model")
    vocabulary = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    assert len([w for w in vocabulary if w.startswith("own")]) == 42  # words of the training part only
    saved = [json.loads(x) for f in (tmp_path / "info.json").glob("part-*") for x in f.read_text().splitlines()]
    assert [x["accuracy"] for x in saved] == [1.0]


def test_training_query_scores_texts_that_were_not_fitted(spark, tmp_path):
    """Classes without a pattern: fitted texts would be scored right by their own words."""
    from ticketscope.plans.registry import all_queries
    rows = [(k, f"own{chr(97 + k // 26)}{chr(97 + k % 26)}", "en" if k % 3 else "de", "web") for k in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    r = all_queries()["ml_train_pipeline"].spark(spark, str(tmp_path)).first()
    assert r.n == 18 and r.accuracy == pytest.approx(12 / 18)  # the larger class for all of them


def test_cross_validation_reads_the_vectors_of_the_training(spark, tmp_path, monkeypatch):
    from ticketscope.operators import ml as ML
    from ticketscope.plans.registry import all_queries
    rows = [(k, f"{('refund', 'crash')[k % 2]} own{chr(97 + k)}", ("en", "de")[k % 2], "web") for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(ML, "tune_cross_validate", lambda prepared, *a, **k: seen.append(prepared) or prepared.select("label"))
    all_queries()["tune_cross_validate"].spark(spark, str(tmp_path))
    assert sorted(seen[0].columns) == ["features", "label"] and seen[0].count() == 20
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "split(" not in plan and "text" not in plan  # texts are neither cleaned nor tokenised again


def test_vectors_equal_the_stages_of_the_model(spark):
    """Tokens for the fit are split at blanks; the fitted stages read the cleaned text by their own patterns."""
    from ticketscope.operators import ml as ML
    from ticketscope.operators.textproc import txt_preprocess
    texts = ["Refund REFUND, the money! a b c", "İstanbul crash error http://x.y z", "x", "não crash 12 error's", "money  money\tcrash",
             "the and", "refund a@b.c late"]
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts * 2)], "ticket_id long, customer_message string, category string")
    model, prepared = ML.ml_train_vectors(df, maxIter=3)
    own = PipelineModel(stages=model.stages[:-2]).transform(txt_preprocess(df).where("length(processed_text) > 0"))
    key = lambda rows: sorted((r.label, str(r.features)) for r in rows)
    assert key(prepared.collect()) == key(own.select("label", "features").collect()) and prepared.count() > 8


def test_training_texts_are_cleaned_once(spark, monkeypatch):
    """A filter on the cleaned text must not clean it a second time."""
    from ticketscope.operators import ml as ML
    seen, real = [], ML.materialize
    monkeypatch.setattr(ML, "materialize", lambda df: seen.append(df) or real(df))
    d = ML._training_texts(tickets(spark, 6), "customer_message", "category")
    assert d.count() == 6 and d.columns == ["category", "processed_text"]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(") == 1
