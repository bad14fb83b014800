"""Skyline against brute force: ties, nulls, hot vectors, many objectives, large integers."""

import random

import pytest
from pyspark.sql import functions as F

from ticketscope.operators.skyline import skyline


def brute(points):
    def dom(a, b):
        if None in a or None in b:
            return False
        return all(x >= y for x, y in zip(a, b)) and any(x > y for x, y in zip(a, b))

    distinct = set(p[1:] for p in points)
    front = {v for v in distinct if not any(dom(u, v) for u in distinct)}
    return sorted(p[0] for p in points if p[1:] in front)


def run(spark, points, d, kind="double"):
    df = spark.createDataFrame(points, "id long, " + ", ".join(f"o{i} {kind}" for i in range(d))).repartition(5)
    return sorted(r.id for r in skyline(df, [f"o{i}" for i in range(d)], id_col="id").collect())


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_matches_brute_force(spark, d):
    rnd = random.Random(d)
    pts = [(i, *(float(rnd.randint(0, 30)) for _ in range(d))) for i in range(600)]
    assert run(spark, pts, d) == brute(pts)


def test_every_row_on_the_front(spark):
    pts = [(i, float(i), float(-i)) for i in range(3000)]
    assert run(spark, pts, 2) == list(range(3000))


def test_equal_rows_stay_and_nulls_stay(spark):
    pts = [(i, 5.0, 5.0) for i in range(400)] + [(1000, 4.0, 5.0), (1001, None, 0.0), (1002, 6.0, None), (1003, 0.0, 6.0)]
    assert run(spark, pts, 2) == sorted([*range(400), 1001, 1002, 1003])


def test_integers_beyond_doubles(spark):
    big = 1 << 60
    pts = [(0, big, 1), (1, big + 1, 1), (2, big + 1, 2), (3, big + 2, 1)]
    assert run(spark, pts, 2, "long") == [2, 3]


def test_more_objectives_than_axes(spark):
    rnd = random.Random(3)
    pts = [(i, *(float(rnd.randint(0, 3)) for _ in range(14))) for i in range(200)]
    assert run(spark, pts, 14) == brute(pts)


def test_empty_and_all_null(spark):
    assert run(spark, [], 2) == []
    assert run(spark, [(1, None, None), (2, None, 1.0)], 2) == [1, 2]


def test_other_columns_pass_through(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, "a"), (2, 0.0, 0.0, "b")], "id long, x double, y double, cell string")
    assert [tuple(r) for r in skyline(df, ["x", "y"], id_col="id").collect()] == [(1, 1.0, 2.0, "a")]
