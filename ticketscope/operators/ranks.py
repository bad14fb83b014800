"""Exact percentiles per group without a group's values in one place.

A bounded quantile sketch brackets each wanted rank (its error is a known share
of the group's rows). One more pass counts the distinct values inside the
brackets and the rows outside, combined map-side; running counts over them give
the value at the exact rank. A task orders ``2 * MARGIN`` of a group's rows per
percentile at most (and fewer where values repeat).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sketch accuracy: ranks are off by at most 1 / ACCURACY of a group's rows.
ACCURACY = 50_000
#: Half the bracket's width as a share of the rows: twice the sketch's error.
MARGIN = 2 / ACCURACY


def exact_percentiles(df: DataFrame, keys: list[str], value: Column | str, shares: list[float]) -> DataFrame:
    """Per group of ``keys`` (null is a group): ``q``, the percentile at each of
    ``shares`` by linear interpolation between neighbouring ranks, the same as
    ``percentile(value, shares)``. Null values are left out; a group without a
    value has no row."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], v.alias("_v")).where("_v is not null")
    ends = sorted({round(min(1.0, max(0.0, s + d)), 9) for s in shares for d in (-MARGIN, MARGIN)})
    sketch = rows.groupBy(*names).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_e"))

    def end(s: float, d: float) -> Column:
        return F.col("_e")[ends.index(round(min(1.0, max(0.0, s + d)), 9))]

    brackets = F.array(*[F.struct(F.lit(i).alias("i"), end(s, -MARGIN).alias("lo"), end(s, MARGIN).alias("hi"),
                                  (F.lit(float(s)) * (F.col("_n") - 1)).alias("at")) for i, s in enumerate(shares)])
    # below, inside and above a bracket; only values inside stay apart
    per_row = sketch.select(*[F.col(n).alias(f"_s{n}") for n in names], brackets.alias("_b"))
    j = rows.join(per_row, _same(names, "_s"))
    placed = j.select(*names, "_v", F.explode("_b").alias("b")).select(
        *names, "b.i", "b.lo", "b.hi", "b.at", "_v",
        F.when(F.col("_v") < F.col("b.lo"), -1).when(F.col("_v") > F.col("b.hi"), 1).otherwise(0).alias("zone"))
    counts = (placed.groupBy(*names, "i", "lo", "hi", "at", "zone", F.when(F.col("zone") == 0, F.col("_v")).alias("x"))
              .agg(F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most")))
    # the value of a zone's rows next to the bracket: its greatest below, its least above
    x = F.coalesce("x", F.when(F.col("zone") < 0, F.col("most")).otherwise(F.col("least")))
    group = [*names, "i"]
    before = Window.partitionBy(*group).orderBy("zone", "x").rowsBetween(Window.unboundedPreceding, -1)
    # one exchange by group serves the running counts and both aggregates
    ranked = counts.withColumn("x", x).repartition(*names).withColumn("from", F.coalesce(F.sum("c").over(before), F.lit(0)))
    low, high = F.floor("at"), F.ceil("at")

    def at_rank(r: Column) -> Column:
        # outside the bracket only the row next to it has a known rank
        known = F.when(F.col("zone") < 0, r == F.col("from") + F.col("c") - 1).when(F.col("zone") > 0, r == F.col("from")).otherwise(
            (r >= F.col("from")) & (r < F.col("from") + F.col("c")))
        return F.max(F.when(known, F.col("x")))

    got = ranked.groupBy(*group).agg(F.first("at").alias("at"), at_rank(low).alias("a"), at_rank(high).alias("b"))
    sure = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col("a"))
    value_at = F.when(low == high, sure).otherwise((high - F.col("at")) * sure + (F.col("at") - low) * F.col("b"))
    listed = got.withColumn("q", value_at).groupBy(*names).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))
    return listed.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "q")


def _same(names: list[str], prefix: str) -> Column:
    """Null-safe equality of ``names`` with their prefixed copies."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{prefix}{n}"))
    return out


def with_percentiles(df: DataFrame, source: DataFrame, keys: list[str], value: Column | str, named: dict[str, float]) -> DataFrame:
    """``df`` (one row per group of ``keys``) with the percentiles of ``source`` as columns ``named``."""
    q = exact_percentiles(source, keys, value, list(named.values()))
    q = q.select(*[F.col(k).alias(f"_q{k}") for k in keys], *[F.col("q")[i].alias(n) for i, n in enumerate(named)])
    return df.join(q, _same(keys, "_q"), "left").drop(*[f"_q{k}" for k in keys])
