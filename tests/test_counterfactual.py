"""Incremental rescoring against scoring every rewritten text with the whole pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketscope.functions.text import txt_clean
from ticketscope.operators import ml
from ticketscope.operators.counterfactual import ex_counterfactual_linear, changed_text

LEXICON = {"Billing": (["refund", "not paid", "the", "refund refund", "unheard", "extra"], ["please refund me", "the invoice", "bill"]),
           "Technical": (["crash", "Error!", "it", "crash error", "broken"], ["it is broken", "crash"]),
           "Account": (["login"], [])}
WORDS = {"Billing": "invoice refund payment charge paid", "Technical": "error crash broken screen", "Account": "login password profile access"}


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = []
    for i in range(90):
        c = list(WORDS)[i % 3]
        rows.append((i, " ".join(r.choice(WORDS[c].split() + ["thing", "today"]) for _ in range(r.randrange(1, 9))), c))
    return ml.ml_train_pipeline(spark.createDataFrame(rows, "ticket_id long, customer_message string, category string"))


def texts():
    r = random.Random(2)
    pool = " ".join(WORDS.values()).split() + ["the", "it", "thing", "novel", "a"]
    out = [" ".join(r.choice(pool) for _ in range(n)) for n in (1, 1, 2, 3, 5, 8, 13, 20)]
    return out + ["Refund! INVOICE 12, see http://x.y", "the", "", None, "novel words only", "login " * 300 + "crash"]


def plain(spark, model, rows, max_keywords=5):
    """All rewritten texts through the pipeline; the rules of the listing in Python."""
    labels = ml.model_labels(model)
    own = {r.id: r for r in ml.ml_predict_batch(model, spark.createDataFrame(rows, "id long, customer_message string, target string")).collect()}
    clean = {r.id: r.c for r in spark.createDataFrame(rows, "id long, t string, target string").select(
        "id", "t").withColumn("c", txt_clean("t")).collect()}
    todo, goals = [], {}
    for i, _, target in rows:
        if target is None:
            probs = own[i].probabilities
            target = sorted(labels, key=lambda c: -probs[c])[1]
        goals[i] = target
        words = clean[i].split()
        kws, phs = LEXICON[target]
        for p in range(len(words)):
            for k, kw in enumerate(kws[:max_keywords]):
                todo.append((i, "word_replacement", p, k, kw, " ".join(words[:p] + [kw] + words[p + 1:])))
        todo += [(i, "phrase_addition", None, k, ph, f"{clean[i]} {ph}") for k, ph in enumerate(phs[:3])]
    scored = ml.ml_predict_batch(model, spark.createDataFrame(
        todo, "id long, change_type string, pos int, k int, term string, customer_message string")).collect()
    out = {}
    for i, *_ in rows:
        hits = [r for r in scored if r.id == i and r.predicted_category == goals[i]]
        rep = sorted((r for r in hits if r.change_type == "word_replacement"), key=lambda r: (r.pos, r.k))[:3]
        listed = (rep + sorted((r for r in hits if r.pos is None), key=lambda r: r.k))
        out[i] = (own[i].predicted_category, own[i].confidence, goals[i],
                  [(r.change_type, r.pos, r.term, r.confidence, r.confidence - own[i].confidence) for r in listed[:5]])
    return out


def test_incremental_scores_equal_full_rescoring(spark, model):
    rows = [(i, t, [None, *LEXICON][i % 4]) for i, t in enumerate(texts() * 2)]
    df = spark.createDataFrame(rows, "id long, body string, target string")
    got = {r.id: r for r in ex_counterfactual_linear(df, model, id_col="id", text_col="body", target_col="target",
                                                     lexicon=LEXICON).collect()}
    want = plain(spark, model, rows)
    assert got.keys() == want.keys()
    n = 0
    for i, (label, conf, goal, listed) in want.items():
        g = got[i]
        assert (g.original_class, g.target_class) == (label, goal) and g.original_confidence == pytest.approx(conf, abs=1e-9)
        assert [(x.change_type, x.pos, x.term) for x in g.counterfactuals] == [x[:3] for x in listed], i
        assert np.allclose([(x.confidence, x.confidence_change) for x in g.counterfactuals], [x[3:] for x in listed], atol=1e-9)
        assert g.success_rate == (1.0 if listed else 0.0)
        n += len(listed)
    assert n > 20


def test_long_text_is_scanned_to_its_third_hit(spark, model):
    """A text of 60,000 words ends; its rewritten texts would hold 18 thousand million."""
    text = "thing " * 60_000 + "crash"
    df = spark.createDataFrame([(1, text)], "id long, body string")
    row = ex_counterfactual_linear(df, model, id_col="id", text_col="body", lexicon=LEXICON).first()
    assert row.original_class != row.target_class and row.success_rate in (0.0, 1.0)


def test_default_lexicon_empty_table_and_changed_text(spark, model):
    empty = spark.createDataFrame([], "id string, body string")
    assert ex_counterfactual_linear(empty, model, id_col="id", text_col="body").collect() == []
    df = spark.createDataFrame([("a b c", 1, "x y"), ("a b c", None, "z")], "t string, pos int, term string")
    assert [r[0] for r in df.select(changed_text(F.col("t"), F.col("pos"), F.col("term"))).collect()] == ["a x y c", "a b c z"]
