"""Assembled features: sparse standardising equals the dense one."""

import numpy as np
import pytest

from ticketscope.operators.assembly import ft_assemble_all, group_features

TEXTS = ["please help, the error is urgent", "refund my order today!", "", None, "error error 12:30 help", "thank you, great help"] * 3


@pytest.fixture(scope="module")
def tickets(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


@pytest.mark.parametrize("with_topics", [False, True])
def test_equals_dense_standardising(spark, tickets, with_topics):
    topics = spark.createDataFrame([(i, [i % 2 / 2, 1 - i % 2 / 2]) for i in range(len(TEXTS))],
                                   "id long, topic_distribution array<double>") if with_topics else None
    rows, scaler = ft_assemble_all(tickets, id_col="id", text_col="text", max_features=50, topics=topics)
    long = group_features(tickets, id_col="id", text_col="text", max_features=50, topics=topics).collect()
    names = sorted({(r.grp, r.feature) for r in long})
    assert {g for g, _ in names} >= {"tfidf", "statistical", "domain", "sentiment"} | ({"topics"} if with_topics else set())
    x = np.zeros((len(TEXTS), len(names)))
    for r in long:
        x[r.id, names.index((r.grp, r.feature))] = r.value
    std = np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    want = (x - x.mean(0)) / std
    table = sorted(scaler.table.collect(), key=lambda r: r["index"])
    assert [(r.grp, r.feature) for r in table] == names and [r["index"] for r in table] == list(range(len(names)))
    shift = np.array([r.mean / r.std for r in table])
    got = np.zeros_like(want) - shift
    found = rows.collect()
    assert sorted(r.id for r in found) == list(range(len(TEXTS)))
    for r in found:
        got[r.id, r.idx] += r.val
        assert r.sq_norm == pytest.approx((want[r.id] ** 2).sum(), rel=1e-9)
    assert np.allclose(got, want, atol=1e-9)


def test_constant_feature_is_centred_only(spark):
    df = spark.createDataFrame([(i, "help") for i in range(4)], "id long, text string")
    rows, scaler = ft_assemble_all(df, id_col="id", text_col="text", max_features=5)
    assert all(r.std == 1.0 for r in scaler.table.collect())
    assert all(abs(r.sq_norm) < 1e-9 for r in rows.collect())


def test_empty_table(spark):
    rows, scaler = ft_assemble_all(spark.createDataFrame([], "id long, text string"), id_col="id", text_col="text")
    assert rows.count() == 0 and scaler.table.count() == 0
