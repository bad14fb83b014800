"""Time intervals as a joinable index: which interval comes first at a time.

Intervals are configuration of any size. Their common time line is cut into
buckets; of the intervals that cover a bucket whole only the first matters, and
those with an end inside it are swept into pieces that do not overlap. A lookup
is an equi-join on the bucket with one matching piece at most.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the time line.
BUCKETS = 1024
#: Stands for an interval without an end.
OPEN = 1 << 62


def sweep(intervals: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces (start, end, least rank) of half-open intervals (start, end, rank), in order, without gaps inside a piece."""
    edges = sorted({e for s, t, _ in intervals if s < t for e in (s, t)})
    todo = sorted(intervals)
    at, active, out = 0, [], []
    for a, b in zip(edges, edges[1:]):
        while at < len(todo) and todo[at][0] <= a:
            s, t, rank = todo[at]
            heapq.heappush(active, (rank, t))
            at += 1
        while active and active[0][1] <= a:
            heapq.heappop(active)
        if active:
            rank = active[0][0]
            if out and out[-1][2] == rank and out[-1][1] == a:
                out[-1] = (out[-1][0], b, rank)
            else:
                out.append((a, b, rank))
    return out


class FirstMatch:
    """Index over ``intervals`` (start, end, rank: long; end exclusive, null: open). The least rank wins."""

    def __init__(self, intervals: DataFrame):
        iv = intervals.select(F.col("start").cast("long").alias("s"), F.coalesce(F.col("end").cast("long"), F.lit(OPEN)).alias("e"),
                              F.col("rank").cast("long").alias("rank")).where("s < e")
        known = F.when(F.col("e") < OPEN, F.col("e")).otherwise(F.col("s") + 1)
        self.low = iv.agg(F.min("s").alias("x")).scalar()
        span = iv.agg((F.floor((F.max(known) - F.min("s")) / F.lit(BUCKETS)) + 1).alias("x")).scalar()
        self.width = span
        wide = iv.withColumn("low", self.low).withColumn("w", span)
        first = F.floor((F.col("s") - F.col("low")) / F.col("w"))
        last = F.least(F.floor((F.col("e") - 1 - F.col("low")) / F.col("w")), F.lit(BUCKETS - 1))
        cells = wide.select("*", F.explode(F.sequence(F.least(first, F.lit(BUCKETS - 1)), last)).alias("bucket"))
        a = F.col("low") + F.col("bucket") * F.col("w")
        b = F.when(F.col("bucket") == BUCKETS - 1, F.lit(OPEN)).otherwise(a + F.col("w"))
        cells = cells.select("bucket", F.greatest("s", a).alias("s"), F.least("e", b).alias("e"), "rank",
                             ((F.col("s") <= a) & (F.col("e") >= b)).alias("full"))
        # of those that cover a bucket whole, one: a partial aggregate, no matter how many intervals
        cells = cells.groupBy("bucket", "full", F.when(~F.col("full"), F.struct("s", "e", "rank")).alias("own")).agg(
            F.min("s").alias("s"), F.max("e").alias("e"), F.min("rank").alias("rank"))

        def pieces(table: pa.Table) -> pa.Table:
            rows = sweep(list(zip(*(table.column(c).to_pylist() for c in ("s", "e", "rank")))))
            return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int64()),
                             **{n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("s", "e", "rank"))}})

        self.pieces = cells.select("bucket", "s", "e", "rank").groupBy("bucket").applyInArrow(
            pieces, "bucket long, s long, e long, rank long")

    def lookup(self, df: DataFrame, at: Column, out: str = "rank") -> DataFrame:
        """``df`` with the first interval's rank at the time ``at`` (long; null without one)."""
        x = df.withColumn("_at", at)
        cell = F.least(F.floor((F.col("_at") - F.col("_low")) / F.col("_w")), F.lit(BUCKETS - 1))
        x = x.withColumn("_low", self.low).withColumn("_w", self.width).withColumn("_bucket", cell)
        p = self.pieces.select(F.col("bucket").alias("_bucket2"), F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("rank").alias(out))
        hit = (F.col("_bucket") == F.col("_bucket2")) & (F.col("_at") >= F.col("_s")) & (F.col("_at") < F.col("_e"))
        return x.join(p, hit, "left").drop("_at", "_low", "_w", "_bucket", "_bucket2", "_s", "_e")


def above_thresholds(df: DataFrame, rules: DataFrame, *, kind: str, value: str, width: dict[str, float]) -> DataFrame:
    """Every (row, rule) with the row's ``value`` above the rule's ``threshold``, kinds equal.

    ``rules`` (kind, threshold, ...) stand in buckets of their threshold's
    ``width`` (by kind); a row meets the buckets from the least rule up to its
    own value, so rules far above it are not looked at.
    """
    def bucket(x: Column, k: Column) -> Column:
        w = F.coalesce(*[F.when(k == F.lit(name), F.lit(float(v))) for name, v in width.items()], F.lit(1.0))
        return F.floor(x / w)

    r = rules.withColumnRenamed(kind, "_kind").withColumn("_bucket", bucket(F.col("threshold"), F.col("_kind")))
    ends = r.groupBy("_kind").agg(F.min("_bucket").alias("lo"), F.max("_bucket").alias("hi"))
    ends = ends.agg(F.map_from_entries(F.collect_list(F.struct(F.col("_kind"), F.struct("lo", "hi"))))).scalar()  # one entry per kind
    x = df.withColumn("_ends", F.element_at(ends, F.col(kind)))
    top = F.least(bucket(F.col(value), F.col(kind)), F.col("_ends.hi"))
    x = x.where(top >= F.col("_ends.lo")).select("*", F.explode(F.sequence(F.col("_ends.lo"), top)).alias("_b")).drop("_ends")
    hit = (F.col(kind) == F.col("_kind")) & (F.col("_b") == F.col("_bucket")) & (F.col(value) > F.col("threshold"))
    return x.join(r, hit).drop("_b", "_bucket", "_kind")
