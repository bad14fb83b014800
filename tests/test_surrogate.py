"""Local surrogates from masks, and lemmas in slices of texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_weights_equal_least_squares():
    from ticketscope.operators.surrogate import surrogate_weights
    r = np.random.default_rng(1)
    for n, v in [(60, 1), (60, 20), (60, 59), (60, 60), (60, 200), (5, 4)]:
        masks = (r.random((n, v)) < 0.5).astype(float)
        masks[0] = 1.0
        if n == 5:
            masks[:, 1] = masks[:, 0]  # not of full rank
        y = r.random(n)
        w = np.exp(-((1 - masks.mean(axis=1)) ** 2) / 0.25 ** 2 / 2)
        a = np.hstack([masks, np.ones((n, 1))]) * w[:, None]
        assert surrogate_weights(masks, y) == pytest.approx(np.linalg.lstsq(a, y * w, rcond=None)[0][:-1], rel=1e-6, abs=1e-9)
    assert not surrogate_weights(masks, np.full(5, 0.3)).any()


def test_factored_solve():
    from ticketscope.operators.surrogate import BLOCK, factored_solve
    r = np.random.default_rng(2)
    for n in (1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK, 3 * BLOCK + 5):
        a = r.random((n, n + 40))
        b = r.random(n)
        assert factored_solve(np.linalg.cholesky(a @ a.T), b) == pytest.approx(np.linalg.solve(a @ a.T, b), rel=1e-7)


@pytest.fixture(scope="module")
def model(spark):
    from ticketscope.operators import ml as ML
    rows = [(i, t, c) for i, (t, c) in enumerate([("invoice refund charge", "Billing"), ("crash error broken", "Technical"),
                                                  ("refund invoice late", "Billing"), ("error login crash", "Technical"),
                                                  ("how what details", "Product"), ("details about price", "Product")] * 2)]
    return ML.ml_train_pipeline(spark.createDataFrame(rows, "ticket_id long, customer_message string, category string"),
                                max_features=12)


def test_masks_score_like_kept_tokens(spark, model):
    from pyspark.ml.functions import vector_to_array

    from ticketscope.operators import ml as ML
    from ticketscope.operators.counterfactual import LinearText
    from ticketscope.operators.explain import ex_local_surrogate
    scorer = ML.token_stages(model)

    def predict_tokens(df):
        return scorer.transform(df.withColumnRenamed("toks_kept", "_tok2")).withColumn("p", F.array_max(vector_to_array("probability")))

    many = [f"word{k}" for k in range(80)] + ["invoice", "crash"]
    rows = [(1, ["invoice", "crash", "invoice", "unseen"]), (2, many), (3, []), (4, ["refund"]), (7, ["error", "refund", "price", "error"])]
    toks = spark.createDataFrame(rows, "id long, toks array<string>")
    for n in (50, 70):  # one and two numbers of bits
        args = dict(id_col="id", tokens_col="toks", n_samples=n, top_k=5)
        old = {(r.doc_id, r.word): r.weight for r in ex_local_surrogate(toks, predict_tokens, **args).collect()}
        new = {(r.doc_id, r.word): r.weight for r in ex_local_surrogate(toks, LinearText.of(scorer), **args).collect()}
        assert new == pytest.approx(old, rel=1e-6, abs=1e-9) and {d for d, _ in new} == {1, 2, 4, 7}


def test_masks_are_sparks_hashes(spark):
    """A task hashes all samples of a document's words itself, to the bit as Spark does."""
    from ticketscope.operators.surrogate import dropped
    words = ["", None, "é", "\U0001F600x", *["abcdefghij" * 9][0:1], *[("qwertyuiop" * 10)[:k] for k in range(1, 101)], *[f"w{k}" for k in range(150)]]
    rows = [(i, k, w) for i in (None, -5, 12345678901) for k, w in enumerate(words)]
    bits = [F.xxhash64("id", F.lit(s), "w", F.lit(42)).bitwiseAND(F.lit(1)).alias(f"s{s}") for s in (1, 2, 77, 130)]
    got = spark.createDataFrame(rows, "id long, k int, w string").select("id", "k", F.xxhash64("id").alias("start"), *bits).collect()
    for i in (None, -5, 12345678901):
        own = sorted((r for r in got if r.id == i), key=lambda r: r.k)
        d = dropped(own[0].start, words, 130, 42)
        assert d.shape == (len(words), 130) and 0.45 < d.mean() < 0.55
        assert [[r.s1, r.s2, r.s77, r.s130] for r in own] == d[:, [0, 1, 76, 129]].tolist()


def test_surrogates_of_repeated_ids_and_batches(spark, model):
    from ticketscope.operators.counterfactual import LinearText
    from ticketscope.operators.explain import ex_local_surrogate
    rows = [(1, ["invoice", "crash"]), (1, ["invoice", "crash"]), (1, ["error", "price", "refund"]), (None, ["late", "details"])]
    rows += [(k, ["invoice", "crash", *[f"w{k}x{j}" for j in range(40)]]) for k in range(10, 60)]
    toks = spark.createDataFrame(rows, "id long, toks array<string>")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "7")
    try:
        got = ex_local_surrogate(toks, LinearText.of(model), id_col="id", tokens_col="toks", n_samples=120, top_k=50).collect()
    finally:
        spark.conf.set(conf, before)
    words = [(r.doc_id, r.word) for r in got]
    assert sorted(words, key=str) == sorted([(i, w) for i, ws in rows for w in ws], key=str)
    assert len({r.weight for r in got if r.doc_id == 1 and r.word == "crash"}) == 1


def test_lemmas_in_slices(spark):
    from ticketscope.operators.textproc import txt_lemma
    lem = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("dogs", "hound"), (None, "x"), ("mice", None)], "word string, lemma string")
    texts = [" cats \t dogs\x0bmice ", "", None, "x", "cats " * 30000, "dogs cats"] * 500
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("tags", F.array(F.lit("a"), F.col("id").cast("string"))) \
        .repartition(3)
    got = txt_lemma(df, "t", lem, id_col="id")
    assert got.columns == ["id", "t", "tags", "lemmatized"]
    lemma = {"cats": "cat", "dogs": "dog"}
    rows = {r.id: r for r in got.withColumn("t", F.md5("t")).withColumn("lemmatized", F.md5("lemmatized")).collect()}
    assert len(rows) == len(texts)
    from hashlib import md5
    want = {t: md5(" ".join(lemma.get(w, w) for w in (t or "").split()).encode()).hexdigest() for t in set(texts)}
    for i, t in enumerate(texts):
        assert rows[i].lemmatized == want[t] and list(rows[i].tags) == ["a", str(i)]
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "posexplode" not in plan  # tokens are not shuffled one by one
    again = txt_lemma(df.limit(6), "t", lem, out="t", id_col="id")
    assert again.columns == ["id", "tags", "t"] and again.count() == 6


def test_letters_only_deletes_the_same_characters(spark):
    import re

    from ticketscope.functions.text import NON_LETTER_RE, fn_letters_only
    text = "".join(map(chr, range(1, 0x250))) + "a b \U0001F600cé-Z"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(fn_letters_only("t")).collect()
    assert [r[0] for r in got] == [re.sub(NON_LETTER_RE, "", text), "", None]


def test_letters_only_reads_long_texts_fast(spark):
    """Single characters in the class, no ranges: over ten times as fast on plain prose."""
    from ticketscope.functions.text import NON_LETTER_RUN_RE
    assert "a-z" not in NON_LETTER_RUN_RE and "A-Z" not in NON_LETTER_RUN_RE
