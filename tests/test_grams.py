"""Vocabulary and rows of n-grams counted in slices."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketscope.operators import features as FE
from ticketscope.operators import grams as G


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i:02d}" for i in range(40)]
    return [(int(i % (n - 3)), " ".join(rng.choice(words, int(rng.integers(0, 30)), p=np.arange(40, 0, -1) / 820))) for i in range(n)]


def by_hand(rows, hi):
    """Counts per (id, n-gram); n-grams stay within a row."""
    c = Counter()
    for i, t in rows:
        w = t.split()
        for n in range(1, hi + 1):
            c.update((i, " ".join(w[k:k + n])) for k in range(len(w) - n + 1))
    return c


@pytest.mark.parametrize(("hi", "size", "bytes_"), [(1, 15, 100), (2, 60, 100), (3, 5000, 100), (3, 50, 1 << 22)])
def test_vocabulary_and_counts(spark, monkeypatch, hi, size, bytes_):
    rows = [*texts(80, hi), (None, "w01 w02"), (None, "w02 w03"), (900, None), (901, "")]
    monkeypatch.setattr(G, "SLICE_BYTES", bytes_)
    df = spark.createDataFrame(rows, "id long, t string")
    want = by_hand([(i, t or "") for i, t in rows], hi)
    total, freq = Counter(), Counter(t for _, t in want)
    for (_, t), n in want.items():
        total[t] += n
    ok = sorted((t for t in total if 2 <= freq[t] <= int(0.95 * len(rows))), key=lambda t: (-total[t], t))[:size]
    got = FE.txt_counts(df, id_col="id", text_col="t", max_features=size, ngram_range=(1, hi)).collect()
    assert {(r.doc_id, r.term): r["count"] for r in got} == {k: n for k, n in want.items() if k[1] in set(ok)}
    assert {r.term: r["index"] for r in got} == {t: i for i, t in enumerate(sorted(ok))}


def test_rare_words_are_left_out_before_counting(spark, monkeypatch):
    asked = []
    plain = G.count_grams
    monkeypatch.setattr(FE, "count_grams", lambda docs, lo, hi, known=None: asked.append((lo, hi, known)) or plain(docs, lo, hi, known))
    df = spark.createDataFrame([(i, f"often also only{i} often also") for i in range(20)], "id long, t string")
    docs = FE.documents_tokens(df, id_col="id", text_col="t", stopwords=False)
    v = FE.fit_vocabulary(docs, ngram_range=(1, 2), max_features=2).collect()
    assert [(r.term, r.total) for r in v] == [("also", 40), ("often", 40)]
    assert asked[1][:2] == (2, 2) and sorted(asked[1][2]) == ["also", "often"]


def test_tfidf_rows_have_unit_length_and_fall_back(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "gamma the")], "id long, t string")
    out = FE.txt_tfidf_pruned(df.union(df.select(F.col("id") + 10, F.lit(None))).union(df.select(F.col("id") + 20, F.lit(""))),
                              id_col="id", text_col="t")
    got = {(r.doc_id, r.term) for r in out.collect()}
    assert got == {(1, "alpha"), (1, "beta"), (1, "alpha beta"), (2, "gamma"), (2, "the"), (2, "gamma the")}
    assert all(abs(r.s - 1) < 1e-12 for r in out.groupBy("doc_id").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("s")).collect())
