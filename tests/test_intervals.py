"""The interval index and threshold buckets against every pair; rule and test tables of any size."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ticketscope.operators.audit import aud_rule_eval
from ticketscope.operators.intervals import FirstMatch, above_thresholds, sweep
from ticketscope.operators.versions import ab_route


@pytest.mark.parametrize("seed", range(6))
def test_sweep_matches_every_point(seed):
    r = random.Random(seed)
    iv = [(a, a + r.randrange(-1, 30), k) for k in range(r.randrange(12)) for a in [r.randrange(60)]]
    pieces = sweep(iv)
    for x in range(-2, 95):
        want = min((k for s, e, k in iv if s <= x < e), default=None)
        assert [k for s, e, k in pieces if s <= x < e] == ([] if want is None else [want])


@pytest.mark.parametrize("n, spread", [(1, 10), (30, 1_000), (400, 10 ** 9)])
def test_first_match_equals_brute_force(spark, n, spread):
    r = random.Random(n)
    iv = [(s, None if r.random() < 0.1 else s + r.randrange(1, spread), k) for k in range(n) for s in [r.randrange(spread)]]
    at = [r.randrange(-spread, 3 * spread) for _ in range(300)] + [s for s, _, _ in iv] + [e for _, e, _ in iv if e]
    index = FirstMatch(spark.createDataFrame(iv, "start long, end long, rank long"))
    got = index.lookup(spark.createDataFrame([(x,) for x in at], "x long"), F.col("x")).collect()
    assert sorted((x, k is None, k or 0) for x, k in got) == sorted(
        (x, w is None, w or 0) for x in at for w in [min((k for s, e, k in iv if s <= x and (e is None or x < e)), default=None)])


def test_no_intervals_match_nothing(spark):
    index = FirstMatch(spark.createDataFrame([], "start long, end long, rank long"))
    assert [x.rank for x in index.lookup(spark.range(3), F.col("id")).collect()] == [None] * 3


def test_thresholds_match_every_pair(spark):
    r = random.Random(2)
    facts = [(i, r.choice(["a", "b", "c"]), r.uniform(-50, 400)) for i in range(200)]
    rules = [(j, r.choice(["a", "b", "d"]), r.uniform(-20, 300)) for j in range(60)]
    got = above_thresholds(spark.createDataFrame(facts, "i int, kind string, value double"),
                           spark.createDataFrame(rules, "j int, kind string, threshold double"),
                           kind="kind", value="value", width={"a": 30.0, "b": 5.0})
    assert sorted((x.i, x.j) for x in got.collect()) == sorted((i, j) for i, k, v in facts for j, q, t in rules if k == q and v > t)


def test_routing_over_a_table_of_many_tests(spark):
    """20,000 tests: more than fit a plan as expressions."""
    day = lambda d: (dt.datetime(2024, 1, 1) + dt.timedelta(hours=d)).strftime("%Y-%m-%d %H:%M:%S")
    tests = spark.range(20_000).select(
        F.col("id").alias("rank"), F.format_string("t%05d", "id").alias("test_id"), F.lit("a").alias("model_a"), F.lit("b").alias("model_b"),
        F.lit(1.0).alias("traffic_split"), F.expr("cast(timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,cast(id as int)) as string)").alias("start_date"),
        F.expr("cast(timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,cast(id + 2 as int)) as string)").alias("end_date"))
    req = spark.createDataFrame([("r1", day(0.5)), ("r2", day(7)), ("r3", day(19_999.5)), ("r4", day(-1)), ("r5", day(20_001)), ("r6", day(20_002))],
                                "request_id string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {x.request_id: (x.test_id, x.model_chosen) for x in ab_route(req, tests).collect()}
    assert got == {"r1": ("t00000", "b"), "r2": ("t00005", "b"), "r3": ("t19998", "b"), "r4": (None, "default"), "r5": ("t19999", "b"),
                   "r6": (None, "default")}


def test_rules_over_a_table_of_many_rules(spark):
    rules = spark.range(15_000).selectExpr("cast(id as string) rule_id", "'n' name", "'retention' rule_type", "'high' severity",
                                           "id % 2 = 0 enabled", "cast(id + 1 as int) retention_days", "cast(null as double) confidence_floor")
    events = spark.createDataFrame([("e1", dt.datetime(2024, 1, 1), "access", None), ("e2", dt.datetime(2023, 12, 22), "prediction", 0.1)],
                                   "event_id string, ts timestamp_ntz, event_type string, confidence double")
    got = sorted(x.violation_id for x in aud_rule_eval(events, rules).collect())
    assert got == sorted(f"{i}:e2" for i in range(0, 9, 2))  # ten days old: rules of one to nine days
    assert aud_rule_eval(events, rules.where("false")).collect() == []
