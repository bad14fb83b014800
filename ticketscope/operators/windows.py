"""Window functions, sorts and top-k operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.constants import EMA_ALPHA


def top_n_per_group(df: DataFrame, group, order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """``row_number() over (partition by group order by ...) <= n``.

    Catalyst turns this into a per-partition group limit (WindowGroupLimit)
    before the shuffle, so a hot group only ships its top n rows.
    """
    group = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def win_top_users(df: DataFrame, *, user_col: str = "user_id", n: int = 10) -> DataFrame:
    """Top n users by activity, null users excluded; ties by user id."""
    c = df.where(F.col(user_col).isNotNull()).groupBy(user_col).agg(F.count("*").alias("activity_count"))
    return c.orderBy(F.desc("activity_count"), F.col(user_col)).limit(n)


def win_last_n(df: DataFrame, *, group, ts: str = "ts", n: int = 10, tiebreak: str | None = None) -> DataFrame:
    """Keep the last n records per group (win_recent_n, win_last5_of_batch)."""
    order = [F.desc(ts)] + ([F.desc(tiebreak)] if tiebreak else [])
    return top_n_per_group(df, group, order, n, "recency_rank")


def win_recent_results(df: DataFrame, *, ts: str = "ts", n: int = 20, tiebreak: str | None = None) -> DataFrame:
    """Most recent n rows (TakeOrderedAndProject: each task keeps n)."""
    order = [F.desc(ts)] + ([F.desc(tiebreak)] if tiebreak else [])
    return df.orderBy(*order).limit(n)


def win_ema(df: DataFrame, *, value: str, group, order: list[str], alpha: float = EMA_ALPHA,
            block: int = 256, out: str = "ema") -> DataFrame:
    """Exponential moving average ``e_1 = x_1, e_n = (1-a) e_{n-1} + a x_n``.

    Closed form without a sequential loop and without overflow:

    * rows get their exact position per group from ``running_totals``
      (range partitioning on (group, order)), so a hot group is spread over
      many tasks instead of one ordered window;
    * positions are cut into blocks of ``block`` rows; inside a block the
      weighted prefix sum uses exponents relative to the block start
      (bounded by (1-a)^-block) - a window over (group, block), i.e. at
      most ``block`` rows per window partition;
    * the carry from earlier blocks is the sum of previous block-end values
      damped by powers of (1-a)^block, taken through equi-joins on
      (group, block - k) with as many k as needed for the dropped tail to
      fall below 1e-18 (two at the defaults).
    """
    from ticketscope.operators.drift import running_totals
    group = [group] if isinstance(group, str) else list(group)
    d = 1.0 - alpha
    # a hashable key for the per-partition fold: the column itself, or the
    # JSON text of the group columns when there are several
    gkey = F.to_json(F.struct(*[F.col(g) for g in group])) if len(group) > 1 else F.col(group[0])
    okey = F.struct(*[F.col(c) for c in order])
    x = df.withColumn("_gk", gkey).withColumn("_ok", okey).withColumn("_one", F.lit(1.0))
    x = running_totals(x, key="_gk", order="_ok", cols=["_one"]).drop("_one", "cum__one")
    x = x.withColumn("_b", F.floor((F.col("rank") - 1) / block)).withColumn(
        "_j", (F.col("rank") - 1 - F.col("_b") * block).cast("int"))
    y = F.when(F.col("rank") == 1, F.col(value) / alpha).otherwise(F.col(value))
    x = x.withColumn("_y", y * F.pow(F.lit(d), -F.col("_j")))
    w_blk = Window.partitionBy("_gk", "_b").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_local", alpha * F.pow(F.lit(d), F.col("_j")) * F.sum("_y").over(w_blk))
    ends = x.groupBy("_gk", "_b").agg(F.max_by("_local", "_j").alias("_end"))
    q = d ** block
    n_lags = max(1, math.ceil(41.5 / (block * -math.log(d))))
    carry = ends.select("_gk", "_b").withColumn("_carry", F.lit(0.0))
    for m in range(1, n_lags + 1):
        prev = ends.select("_gk", (F.col("_b") + m).alias("_b"), (F.col("_end") * (q ** (m - 1))).alias(f"_e{m}"))
        carry = carry.join(prev, ["_gk", "_b"], "left").withColumn(
            "_carry", F.col("_carry") + F.coalesce(F.col(f"_e{m}"), F.lit(0.0))).drop(f"_e{m}")
    x = x.join(carry, ["_gk", "_b"])
    res = F.col("_local") + F.pow(F.lit(d), F.col("_j") + 1) * F.col("_carry")
    return x.withColumn(out, res).drop("_gk", "_ok", "rank", "_b", "_j", "_y", "_local", "_carry")


def srt_probabilities(df: DataFrame, *, id_col: str, map_col: str = "probabilities") -> DataFrame:
    """Explode a probability map, categories by probability descending per row."""
    e = df.select(id_col, F.explode(map_col).alias("category", "probability"))
    w = Window.partitionBy(id_col).orderBy(F.desc("probability"), "category")
    return e.withColumn("rank", F.row_number().over(w))


def srt_feature_importance(importances: DataFrame, *, n: int = 10) -> DataFrame:
    """Top-n (feature, importance) rows; ties by feature name."""
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def win_error_samples(df: DataFrame, *, group, ts: str = "ts", text: str = "text", n: int = 5,
                      width: int = 100) -> DataFrame:
    """First n example texts per group, cut to ``width`` chars, as an ordered array.

    ``max_by``-style: a group-limit window first, so at most n rows per
    group reach the collect.
    """
    group = [group] if isinstance(group, str) else list(group)
    firsts = top_n_per_group(df, group, [F.col(ts), F.col(text)], n, "_r")
    return firsts.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("_r"), F.substring(text, 1, width).alias("t")))),
                    lambda s: s["t"]).alias("samples"))
