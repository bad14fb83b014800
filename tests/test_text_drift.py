"""Six drift methods over text components; the domain classifier against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from ticketscope.operators import drift as D
from ticketscope.operators.text_drift import TextReference, fit_reference, text_features


def plain_auc(ref, cur, bins, grid):
    """Cross-fitted log-odds scores and the rank statistic, in Python."""
    rows = [(s, str(i), x) for s, part in (("ref", ref), ("cur", cur)) for i, x in part]
    width = len(rows[0][2])
    lo = [min(r[2][j] for r in rows if r[2][j] is not None) for j in range(width)]
    hi = [max(r[2][j] for r in rows if r[2][j] is not None) for j in range(width)]
    half = [0 if hashlib.md5(f"{s}:{i}".encode()).hexdigest() < "8" else 1 for s, i, _ in rows]
    cell = [tuple(-1 if x[j] is None else 0 if hi[j] == lo[j] else min(int((x[j] - lo[j]) * bins / (hi[j] - lo[j])), bins - 1)
                  for j in range(width)) for _, _, x in rows]

    def odds(h, j, b):
        n = {s: sum(1 for k, r in enumerate(rows) if half[k] == h and r[0] == s) for s in ("ref", "cur")}
        c = {s: sum(1 for k, r in enumerate(rows) if half[k] == h and r[0] == s and cell[k][j] == b) for s in ("ref", "cur")}
        if not sum(c.values()):
            return 0
        return round((math.log((c["cur"] + 1) / (n["cur"] + bins)) - math.log((c["ref"] + 1) / (n["ref"] + bins))) * grid)

    memo: dict = {}
    score = [sum(memo.setdefault((1 - half[k], j, b), odds(1 - half[k], j, b)) for j, b in enumerate(cell[k])) for k in range(len(rows))]
    r = [s for s, row in zip(score, rows) if row[0] == "ref"]
    c = [s for s, row in zip(score, rows) if row[0] == "cur"]
    return sum((y > x) + (y == x) / 2 for x in r for y in c) / (len(r) * len(c))


@pytest.mark.parametrize("shift", [0.0, 1.5])
def test_domain_classifier_matches_brute_force(spark, shift):
    r = random.Random(4)
    ref = [(i, (r.gauss(0, 1), None if i % 17 == 0 else r.random(), 3.0)) for i in range(150)]
    cur = [(i, (r.gauss(shift, 1), r.random(), 3.0)) for i in range(90)]
    frame = lambda rows: spark.createDataFrame([(i, *x) for i, x in rows], "id long, a double, b double, c double")
    got = D.drift_domain_classifier(frame(ref), frame(cur), ["a", "b", "c"]).first()
    assert got.n == 240 and got.auc == pytest.approx(plain_auc(ref, cur, D.DOMAIN_BINS, D.DOMAIN_GRID), abs=1e-9)
    assert got.drift_detected == (shift > 0)


def samples(spark, words, n, seed):
    r = random.Random(seed)
    return spark.createDataFrame([(seed * 1000 + i, " ".join(r.choice(words) for _ in range(r.randrange(3, 15))), "xy"[i % 2])
                                  for i in range(n)] + [(seed * 1000 + 999, None, None)], "id long, text string, label string")


def test_report_has_six_votes_and_the_covariate_message(spark):
    ref = samples(spark, "alpha beta gamma delta".split(), 120, 1)
    fitted, stats, texts = fit_reference(ref, id_col="id", text_col="text", label_col="label", max_features=50, k=5)
    st = {x.feature: x for x in stats.collect()}
    assert {f"f{i:03d}" for i in range(5)} <= st.keys() and st["label=x"]["mean"] == 60 and st["label=null"]["mean"] == 1
    own = np.array([x.features for x in text_features(ref, fitted, id_col="id", text_col="text").collect()])
    assert own.shape == (121, 5)
    assert np.allclose(own.mean(0), 0, atol=1e-6) and np.allclose(own.std(0), 1, atol=1e-3)
    for i in range(5):
        x = st[f"f{i:03d}"]
        assert np.allclose([x["mean"], x["std"], x["min"], x["max"]], [own[:, i].mean(), own[:, i].std(), own[:, i].min(), own[:, i].max()], atol=1e-9)
        assert np.allclose([x.p25, x.p50, x.p99], np.quantile(own[:, i], [0.25, 0.5, 0.99]))
    t = texts.first()
    assert t.vocab_size == 4 and set(t.common_words) == {"alpha", "beta", "gamma", "delta"}

    def report(cur):
        def wide(df):
            x = text_features(df, fitted, id_col="id", text_col="text")
            return x.join(df.select("id", "label"), "id").selectExpr("id", "label", *[f"features[{i}] f{i}" for i in range(5)])
        return D.drift_report(wide(ref), wide(cur), [f"f{i}" for i in range(5)]).cache()

    drifted = report(samples(spark, "alpha alpha alpha epsilon".split(), 120, 2))
    assert {r.method for r in drifted.collect()} == {"ks_test", "psi", "js_divergence", "wasserstein", "chi2_test", "covariate_shift"}
    a = D.drift_assess(drifted).first()
    assert a.total_methods == 6 and a.overall_drift_detected
    assert any("Covariate shift" in m for m in D.drift_recommend(drifted).first().recommendations)
    calm = {r.method: r for r in report(ref).collect()}
    assert not calm["covariate_shift"].drift_detected and not calm["psi"].drift_detected


def test_reference_state_round_trip(spark, tmp_path):
    ref = samples(spark, "alpha beta gamma delta".split(), 40, 3)
    fitted, _, _ = fit_reference(ref, id_col="id", text_col="text", max_features=30, k=3)
    fitted.save(spark, str(tmp_path / "ref"))
    again = TextReference.load(spark, str(tmp_path / "ref"))
    a, b = ({x.id: x.features for x in text_features(ref, f, id_col="id", text_col="text").collect()} for f in (fitted, again))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_domain_classifier_reads_its_odds_by_position(spark):
    """A map of features x bins entries would be searched for every feature of every row."""
    import re
    r = random.Random(6)
    names = [f"f{i}" for i in range(30)]
    ref = [(i, tuple(r.gauss(0, 1) for _ in names)) for i in range(40)]
    cur = [(i, tuple(None if j == 3 else r.gauss(j == 7, 1) for j in range(30))) for i in range(25)]
    frame = lambda rows: spark.createDataFrame([(i, *x) for i, x in rows], "id long, " + ", ".join(f"{n} double" for n in names))
    out = D.drift_domain_classifier(frame(ref), frame(cur), names)
    assert out.first().auc == pytest.approx(plain_auc(ref, cur, D.DOMAIN_BINS, D.DOMAIN_GRID), abs=1e-9)
    long = []
    real = D.running_totals
    try:
        D.running_totals = lambda df, **k: long.append(df) or real(df, **k)
        D.drift_domain_classifier(frame(ref), frame(cur), names)
    finally:
        D.running_totals = real
    plan = long[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"element_at\(m#\d+, (named_)?struct", plan)


def test_reference_texts_are_tokenised_once(spark, monkeypatch):
    from ticketscope.operators import text_drift as T
    seen, real = [], T.documents_tokens
    monkeypatch.setattr(T, "documents_tokens", lambda df, **k: seen.append(df) or real(df, **k))
    T.fit_text_reference(samples(spark, "alpha beta gamma".split(), 20, 5), id_col="id", text_col="text", max_features=10, k=2)
    assert len(seen) == 1
