"""Cooldown in ranges against the sequential rule."""

import datetime as dt
import random

import numpy as np
import pytest

from ticketscope.operators.cooldown import apply_cooldown, kept_times, last_reached, pointers
from ticketscope.operators.monitor import mon_cooldown


def sequential(events, gap):
    """Kept (key, at) of (key, at, seed), one after the other."""
    out, last = set(), {}
    for k, at, seed in sorted(set(events), key=lambda e: (e[0], e[1], not e[2])):
        if seed:
            last[k] = at
        elif k not in last or at - last[k] >= gap:
            last[k] = at
            out.add((k, at))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("parts", [1, 7])
def test_kept_times_match_the_sequential_rule(spark, seed, parts):
    r = random.Random(seed)
    spread = r.choice([300, 3_000, 100_000])
    events = [("hot" if r.random() < 0.8 else r.choice("abc"), r.randrange(spread), r.random() < (0.02 if seed % 2 else 0)) for _ in range(3_000)]
    df = spark.createDataFrame(events, "key string, at long, seed boolean").repartition(3)
    for gap in (1, 60, 1_000):
        got = [tuple(x) for x in kept_times(df, gap_micros=gap, num_partitions=parts).collect()]
        assert len(got) == len(set(got)) and set(got) == sequential(events, gap)


def test_pointers_and_their_ends():
    at, seed = np.array([0, 5, 10, 12, 30, 31]), np.array([0, 0, 0, 1, 0, 0], bool)
    assert pointers(at, seed, 10).tolist() == [2, 3, 3, 4, 6, 6]
    assert last_reached(pointers(at, seed, 10)).tolist() == [4, 4, 4, 4, 4, 5]


def test_alert_rows_nulls_ties_and_stored_ones(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", "m", t(0), 1), ("a", "m", t(0), 2), ("a", "m", t(59), 3), ("a", "m", t(60), 4), (None, "m", t(5), 5),
            ("null", "m", t(6), 6), ("a", None, t(7), 7), ("a", "m", None, 8), ("b", "m", t(10), 9)]
    df = spark.createDataFrame(rows, "alert_type string, model_name string, ts timestamp_ntz, n int")
    got = sorted(x.n for x in mon_cooldown(df, cooldown_minutes=60).collect())
    assert got in ([1, 4, 5, 6, 7, 9], [2, 4, 5, 6, 7, 9])
    stored = spark.createDataFrame([("b", "m", t(-30)), ("a", "m", t(30))], "alert_type string, model_name string, ts timestamp_ntz")
    got = sorted(x.n for x in mon_cooldown(df, cooldown_minutes=60, stored=stored).collect())
    assert got in ([1, 5, 6, 7], [2, 5, 6, 7])
    assert mon_cooldown(df.where("false")).collect() == []


def test_one_hot_key_is_spread(spark):
    """400,000 alerts of one key: no range holds more than its share."""
    df = spark.range(400_000).selectExpr("'k' alert_type", "'m' model_name", "timestamp_micros(id * 1000003) ts")
    kept = apply_cooldown(df, keys=["alert_type", "model_name"], gap_micros=3_600_000_000, num_partitions=8)
    n = kept.count()
    step = -(-3_600_000_000 // 1_000_003)
    assert n == -(-400_000 // step)
