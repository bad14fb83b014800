"""op1 and op2 against brute force, and their awkward cases."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm.fixtures import documents, labels, prose, words
from ticketscope.llm.mixing import DOMAINS, fit_rates, mix, mixing_rates
from ticketscope.llm.outliers import base_stats, quality_rules, robust_estimates, transformed


def brute_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_counts_match_brute_force(spark):
    docs = documents(spark)
    got = Counter(tuple(r) for r in quality_rules(docs, steps=1).select("doc_id", *COUNTS, "base_failed").collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        c = brute_counts(r.text)
        want[(r.doc_id, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert got == want


def test_estimates_are_the_least_determinant_subset(spark):
    """One group of plain documents and some junk: the scatter ignores the junk."""
    rows = [(i, prose(i, 100 + i), "en", "a") for i in range(40)] + [
        (100 + i, "w### " * 30 + prose(i, 60), "en", "a") for i in range(8)]
    z = transformed(base_stats(documents(spark, rows)))
    z = z.where(~z.base_failed)
    e = robust_estimates(z.select("doc_id", "g", "x1", "x2", "x3", "x4", "x5")).collect()
    assert len(e) == 1
    pdf = z.toPandas()
    clean = pdf[pdf.doc_id < 100]
    assert abs(e[0].m2 - clean.x3.mean()) < 0.05          # symbols of the junk do not move the centre
    assert abs(e[0].m0 - clean.x1.mean()) < 0.3
    assert e[0].l22 ** 2 == pytest.approx(0.04, abs=0.01)  # nor widen the spread beyond its floor
    kept = {r.doc_id: r.kept for r in quality_rules(documents(spark, rows)).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(8))


def test_an_outlier_in_any_one_statistic_is_rejected(spark):
    def lines(i):
        return "\n".join(prose(i * 100 + k, 12) for k in range(10))

    whole = prose(900, 40_000).split()
    odd = {
        "x1": "\n".join(" ".join(whole[k:k + 12]) for k in range(0, len(whole), 12)),
        "x2": " ".join(w + "ka" * 4 for w in lines(70).split()),
        "x3": lines(71).replace(" ", "# ", 20),
        "x4": lines(72) + "\n" + " ".join(lines(72).split()[:15]),
        "x5": "\n".join(f"{x}\nYes." for x in lines(73).split("\n")),
    }
    rows = [(i, lines(i), "en", "a") for i in range(60)] + [(100 + k, t, "en", "a") for k, t in enumerate(odd.values())]
    z = transformed(base_stats(documents(spark, rows))).toPandas().set_index("doc_id")
    assert not z.base_failed.any()
    got = {r.doc_id: r.kept for r in quality_rules(documents(spark, rows)).collect()}
    assert all(got[i] for i in range(60))
    assert [x for k, x in enumerate(odd) if got[100 + k]] == []
    assert z.x4[103] > 0.1 and z.x4.drop(103).max() == 0 and z.x5.drop(104).max() == 0 and z.x3.drop(102).max() == 0


def test_distance_matches_numpy(spark):
    rows = [(i, prose(i, 40 + 7 * i), "en", "a") for i in range(30)]
    docs = documents(spark, rows)
    z = transformed(base_stats(docs))
    e = robust_estimates(z.select("doc_id", "g", "x1", "x2", "x3", "x4", "x5"), steps=1).first()
    m = np.array([e[f"m{i}"] for i in range(5)])
    low = np.array([[e[f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
    d2 = {r.doc_id: r.d2 for r in quality_rules(docs, steps=1).collect()}
    for r in z.toPandas().itertuples():
        x = np.array([r.x1, r.x2, r.x3, r.x4, r.x5]) - m
        assert d2[r.doc_id] == pytest.approx(x @ np.linalg.inv(low @ low.T) @ x, rel=1e-6, abs=1e-9)


def test_rules_on_empty_table(spark):
    docs = documents(spark, [])
    assert quality_rules(docs).count() == 0


def test_rules_beyond_the_broadcast_bound(spark, monkeypatch):
    import ticketscope.llm.outliers as o
    rows = [(i, prose(i, 60 + i), "en", f"s{i % 3}") for i in range(30)]
    want = {r.doc_id: round(r.d2, 9) for r in quality_rules(documents(spark, rows), steps=1).collect()}
    monkeypatch.setattr(o, "BROADCAST_ROWS", 0)
    assert {r.doc_id: round(r.d2, 9) for r in quality_rules(documents(spark, rows), steps=1).collect()} == want


def corpus():
    rows, known = [], []
    for i in range(240):
        kind = i % 3
        extra = ["", " moron idiot", " ### $$$ |"][kind]
        rows.append((i, " ".join(w + extra for w in prose(i, 30).split()), "en", "a"))
        if i < 180:
            known.append((i, int(kind != 2), int(kind == 1)))
    return rows, known


def test_rates_reach_the_targets(spark):
    rows, known = corpus()
    targets = {"good": 0.7, "toxic": 0.2, "poor": 0.1}
    r = mixing_rates(documents(spark, rows), labels(spark, known), targets).toPandas()
    whole = r.n_tokens.sum()
    for d in DOMAINS:
        assert (r.rate * r.n_tokens * r[f"p_{d}"]).sum() / whole == pytest.approx(targets[d], abs=1e-3)
    assert (r.rate >= 0).all()
    assert r[[f"p_{d}" for d in DOMAINS]].sum(1).to_numpy() == pytest.approx(1)
    pick = r.set_index("doc_id")[[f"p_{d}" for d in DOMAINS]].to_numpy().argmax(1)
    assert (pick[180:] == np.arange(180, 240) % 3).mean() > 0.8  # unlabelled documents


def test_rates_solve_the_least_squares_problem(spark):
    """Kept at rate 0 where the target asks for less than nothing, and stationary elsewhere."""
    p = np.random.default_rng(1).dirichlet([0.6, 0.6, 0.6], 200)
    t = np.arange(1, 201)
    df = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p)], "n_tokens long, p0 double, p1 double, p2 double")
    fit = fit_rates(df, {"good": 0.9, "toxic": 0.05, "poor": 0.05})
    assert np.abs(np.array(fit.totals) - fit.targets).max() / t.sum() < 1e-3
    r = np.ones(200)
    for u in fit.steps:
        r = np.maximum(0, r - p @ u)
    assert (r @ (t[:, None] * p)) == pytest.approx(fit.totals)


def nearest_rates(p, t, goal, n=20_000):
    """The nearest rates by another method: Dykstra's alternating projections on r >= 0 and on each total."""
    w = np.sqrt(t)
    x, a = w.copy(), p * w[:, None]  # x = sqrt(t) r, so distances are plain
    lift = np.zeros_like(x)
    q = np.linalg.inv(a.T @ a)
    for _ in range(n):
        y = x - a @ (q @ (a.T @ x - goal))
        x2 = np.maximum(0, y + lift)
        lift = y + lift - x2
        if np.abs(x2 - x).max() < 1e-11:
            return x2 / w
        x = x2
    return x / w


@pytest.mark.parametrize("goal", [(0.97, 0.025, 0.005), (0.978, 0.02, 0.002), (0.95, 0.049, 0.001)])
def test_hard_targets_match_an_independent_solver(spark, goal):
    """Targets that put many documents at rate 0."""
    r = np.random.default_rng(4)
    p = r.dirichlet([6, 0.25, 0.25], 300)
    t = r.integers(1, 400, 300)
    df = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p)], "n_tokens long, p0 double, p1 double, p2 double")
    fit = fit_rates(df, dict(zip(DOMAINS, goal)))
    assert fit.misfit() < 1e-4
    (u,) = fit.steps
    mine = np.maximum(0, 1 - p @ u)
    want = nearest_rates(p, t, np.array(fit.totals))
    assert (mine == 0).any() and np.abs(mine - want).max() < 2e-2
    assert (t * (mine - 1) ** 2).sum() <= (t * (want - 1) ** 2).sum() * (1 + 1e-4)


def test_targets_out_of_reach_show_their_misfit(spark):
    df = spark.createDataFrame([(10, 1.0, 0.0, 0.0), (20, 1.0, 0.0, 0.0)], "n_tokens long, p0 double, p1 double, p2 double")
    fit = fit_rates(df, {"good": 0.5, "toxic": 0.5, "poor": 0.0}, max_steps=20)
    assert fit.misfit() == pytest.approx(0.5, abs=1e-3) and fit.totals[0] == pytest.approx(15, abs=0.1)


def test_domains_at_most_at_their_own_share(spark):
    """A rare domain is not filled by repeating its few documents."""
    p = np.random.default_rng(2).dirichlet([8, 0.8, 0.01], 200)
    t = np.random.default_rng(3).integers(1, 300, 200)
    df = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p)], "n_tokens long, p0 double, p1 double, p2 double")
    own = (t[:, None] * p).sum(0)
    fit = fit_rates(df, {"good": 0.93, "toxic": 0.02, "poor": 0.05}, at_most=("toxic", "poor"))
    assert fit.misfit() < 1e-4
    assert np.allclose(fit.totals, [own.sum() * 0.98 - own[2], own.sum() * 0.02, own[2]], atol=2e-4 * own.sum())
    free = fit_rates(df, {"good": 0.93, "toxic": 0.02, "poor": 0.05})
    assert np.maximum(0, 1 - p @ fit.steps[0]).max() < 5 < 10 * 5 < np.maximum(0, 1 - p @ free.steps[0]).max()


def test_registered_targets_are_reached(spark, sf):
    from ticketscope.llm.queries import QUERIES
    r = QUERIES["op2_soft_mixing"](spark, sf).toPandas()
    whole = r.n_tokens.sum()
    for d, goal in {"good": 0.97, "toxic": 0.025, "poor": 0.005}.items():
        assert abs((r.rate * r.n_tokens * r[f"p_{d}"]).sum() / whole - goal) < 1e-4
    assert (r.misfit < 1e-4).all()


def test_mixing_awkward_rows(spark):
    docs = documents(spark)
    r = mixing_rates(docs, labels(spark, [(0, 1, 0), (14, 0, 0), (11, 0, 0), (None, 1, 1), (1, None, 0), (99, 1, 1)]))
    assert r.count() == docs.count()
    assert r.where("rate is null or rate < 0 or n_tokens is null").count() == 0
    assert mixing_rates(docs, labels(spark, [])).where("rate is null").count() == 0
    assert mixing_rates(documents(spark, []), labels(spark, [(0, 1, 0)])).count() == 0


def test_mix_copies_rows_by_rate(spark):
    rows, known = corpus()
    docs, lab = documents(spark, rows), labels(spark, known)
    targets = {"good": 0.9, "toxic": 0.05, "poor": 0.05}
    out = mix(docs, lab, targets)
    assert out.columns == docs.columns
    n = Counter(r.doc_id for r in out.select("doc_id").collect())
    for r in mixing_rates(docs, lab, targets).collect():
        assert n[r.doc_id] in (int(r.rate), int(r.rate) + 1)


def test_rows_of_the_registered_rules(spark, sf):
    from ticketscope.llm.queries import QUERIES
    con = duckdb.connect()
    got = QUERIES["op1_mcd_quality_rules"](spark, sf).toPandas()
    texts = dict(con.execute(f"select doc_id, text from read_parquet('{sf}/documents.parquet')").fetchall())
    assert len(got) == len(texts)
    for r in got.itertuples():
        assert tuple(getattr(r, c) for c in COUNTS) == brute_counts(texts[r.doc_id])
    good = con.execute(f"select doc_id from read_parquet('{sf}/labels.parquet') where quality = 1").fetchall()
    kept = set(got[got.kept].doc_id)
    fine = [d for d, in good if d in set(got[~got.base_failed].doc_id)]
    assert sum(d in kept for d in fine) >= 0.97 * len(fine)
