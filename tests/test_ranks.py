"""Rank selection against numpy, over hot groups, ties and odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketscope.operators import ranks
from ticketscope.operators.ranks import exact_percentiles, with_percentiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]


def groups():
    r = np.random.default_rng(5)
    return {"hot": r.lognormal(0, 3, 60_000), "ties": r.integers(0, 3, 20_000).astype(float), "one": np.array([7.5]), "two": np.array([1.0, 2.0]),
            "wide": np.concatenate(([-1e300, 1e300], r.standard_normal(5_000))), "same": np.full(30_000, 2.5), None: r.random(101)}


def test_percentiles_match_numpy(spark):
    data = groups()
    rows = [(g, float(x)) for g, xs in data.items() for x in xs] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r.g: list(r.q) for r in exact_percentiles(df, ["g"], "x", SHARES).collect()}
    assert got.keys() == data.keys()
    for g, xs in data.items():
        assert np.allclose(got[g], np.quantile(xs, SHARES), rtol=1e-12, atol=0), g


def test_bracket_is_narrow_and_ranks_are_exact(spark):
    """A million rows of one group: percentiles equal the sorted values' and Spark's own."""
    df = spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(10 ** 9)).cast("double").alias("x"), F.lit(1).alias("g"))
    got = exact_percentiles(df, ["g"], "x", [0.5, 0.999]).first().q
    assert list(got) == df.agg(F.percentile("x", [0.5, 0.999])).first()[0]


def test_a_rank_outside_its_bracket_fails_loudly(spark, monkeypatch):
    monkeypatch.setattr(ranks, "MARGIN", 0.0)
    monkeypatch.setattr(ranks, "ACCURACY", 2)
    df = spark.range(5_000).select(F.pmod(F.xxhash64("id"), F.lit(10 ** 6)).cast("double").alias("x"), F.lit(1).alias("g"))
    with pytest.raises(Exception, match="outside its bracket"):
        exact_percentiles(df, ["g"], "x", [0.37]).collect()


def test_with_percentiles_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "g string, x double")
    base = df.groupBy("g").agg(F.count("*").alias("n"))
    got = {r.g: (r.n, r.mid) for r in with_percentiles(base, df, ["g"], "x", {"mid": 0.5}).collect()}
    assert got == {"a": (2, 2.0), None: (1, 5.0), "b": (1, None)}
    assert exact_percentiles(df.where("false"), ["g"], "x", [0.5]).collect() == []
