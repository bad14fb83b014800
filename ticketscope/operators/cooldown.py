"""Greedy cooldown of alerts without a sequential pass over a hot key.

An alert is kept if a cooldown has passed since the last kept one. From a kept
alert the next kept one is fixed (the first at least a cooldown later), so each
range of a key's time line is a function from the last kept time before it to
the last kept time in it, decided by the alerts of its first cooldown window.
Ranges work in parallel: one pass finds each range's function by pointer
jumping, a short fold chains the functions of a key's ranges, and a second pass
marks what each range keeps.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ticketscope.operators._util import epoch_micros
from ticketscope.session import materialize

#: Before the first and after the last possible time.
NEVER = -(1 << 62)
ALWAYS = 1 << 62


def pointers(at: np.ndarray, seed: np.ndarray, gap: int) -> np.ndarray:
    """Index of the event after each one if it is kept: the first at least ``gap``
    later, or the first seed if that comes before (len(at): none)."""
    n = len(at)
    later = np.searchsorted(at, at + gap, "left")
    seeds = np.append(np.flatnonzero(seed), n)
    return np.minimum(np.maximum(later, np.arange(n) + 1), seeds[np.searchsorted(seeds, np.arange(n), "right")])


def last_reached(nxt: np.ndarray) -> np.ndarray:
    """Last event on the way from each event, by pointer jumping."""
    own = np.arange(len(nxt))
    hop = np.where(nxt < len(nxt), nxt, own)
    while True:
        further = hop[hop]
        if np.array_equal(further, hop):
            return hop
        hop = further


def pieces(at: np.ndarray, seed: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """A range's function as (up to, last kept time): for the least ``up to`` that
    is not before last kept + gap; no entry: nothing is kept."""
    nxt = pointers(at, seed, gap)
    end = at[last_reached(nxt)]
    first_seed = int(np.argmax(seed)) if seed.any() else len(at)
    reach = min(int(np.searchsorted(at, at[0] + gap, "left")), first_seed, len(at) - 1)
    up_to = at[:reach + 1].copy()
    if reach == first_seed:
        up_to[reach] = ALWAYS  # a seed moves the clock whatever came before
    ends = end[:reach + 1]
    keep = np.append(ends[1:] != ends[:-1], True)
    return list(zip(up_to[keep].tolist(), ends[keep].tolist()))


def kept_events(at: np.ndarray, seed: np.ndarray, gap: int, last: int) -> np.ndarray:
    """Indices of the alerts that a range keeps, given the last kept time before it."""
    first_seed = int(np.argmax(seed)) if seed.any() else len(at)
    i = min(int(np.searchsorted(at, last + gap if last > NEVER else NEVER, "left")), first_seed)
    nxt, out = pointers(at, seed, gap), []
    while i < len(at):
        if not seed[i]:
            out.append(i)
        i = int(nxt[i])
    return np.array(out, np.int64)


def key_ranges(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The key and the columns ``names`` of each key's rows in a partition ordered by key; holds one key's part at a time."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").dictionary_encode()
        code = keys.indices.to_numpy()
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        edges = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        for a, b in zip(edges, [*edges[1:], len(code)]):
            k = keys.dictionary[int(code[a])].as_py()
            if k != key and held:
                yield key, *map(np.concatenate, zip(*held))
                held = []
            key = k
            held.append([c[a:b] for c in columns])
    if held:
        yield key, *map(np.concatenate, zip(*held))


def kept_times(events: DataFrame, *, gap_micros: int, num_partitions: int | None = None) -> DataFrame:
    """(key, at) of the kept alerts of ``events`` (key string, at long micros, seed boolean).

    Seeds are alerts already stored: they start the clock anew and are not
    returned. Equal times of a key are one event. A task holds one range of one
    key's times; the chaining fold reads the pieces of a key, range by range.
    """
    spark = events.sparkSession
    p = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a seed stands before an alert of its time; both passes must see the same ranges
    lines = materialize(events.distinct().repartitionByRange(p, "key", "at").sortWithinPartitions("key", "at", F.desc("seed"))
                        .withColumn("part", F.spark_partition_id()))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, at, seed, part in key_ranges(batches, "at", "seed", "part"):
            parts = pieces(at, seed, gap_micros)
            yield pa.RecordBatch.from_pydict({"key": [key], "part": pa.array([int(part[0])], pa.int32()),
                                              "up_to": pa.array([[a for a, _ in parts]], pa.list_(pa.int64())),
                                              "ends": pa.array([[b for _, b in parts]], pa.list_(pa.int64()))})

    functions = lines.mapInArrow(summary, "key string, part int, up_to array<long>, ends array<long>")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, NEVER
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    key, last = row["key"], NEVER
                rows.append((key, row["part"], last))
                at = int(np.searchsorted(row["up_to"], last + gap_micros if last > NEVER else NEVER, "left"))
                if at < len(row["ends"]):
                    last = row["ends"][at]
            yield pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.string()),
                                              "part": pa.array([r[1] for r in rows], pa.int32()),
                                              "last": pa.array([r[2] for r in rows], pa.int64())})

    # partitions follow each other in time within a key
    entries = functions.repartition("key").sortWithinPartitions("key", "part").mapInArrow(
        chain, "key string, part int, last long")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, at, seed, last in key_ranges(batches, "at", "seed", "last"):
            kept = kept_events(at, seed, gap_micros, int(last[0]))
            yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(kept), pa.string()), "at": pa.array(at[kept], pa.int64())})

    # keys + partitions rows at most (a key's ranges are neighbours): broadcast, so the rows keep their order
    return lines.join(F.broadcast(entries), ["key", "part"]).select("key", "at", "seed", "last").mapInArrow(
        mark, "key string, at long")


def micros(alerts: DataFrame, col: str = "ts") -> Column:
    """Microseconds of a timestamp column of either kind."""
    return epoch_micros(F.col(col)) if isinstance(alerts.schema[col].dataType, TimestampNTZType) else F.unix_micros(col)


def apply_cooldown(alerts: DataFrame, *, keys: list[str], gap_micros: int, stored: DataFrame | None = None,
                   num_partitions: int | None = None) -> DataFrame:
    """The kept rows of ``alerts`` per combination of ``keys`` (null is a value).

    Of rows with one key and time one is kept at most. Rows without a time are
    left out.
    """
    key = F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")) for k in keys]))

    def events(df, seed):
        return df.where("ts is not null").select(key.alias("key"), micros(df).alias("at"), F.lit(seed).alias("seed"))

    src = events(alerts, False)
    if stored is not None:
        src = src.unionByName(events(stored, True))
    kept = kept_times(src, gap_micros=gap_micros, num_partitions=num_partitions)
    named = alerts.withColumn("_key", key).withColumn("_at", micros(alerts))
    return (named.join(kept.select(F.col("key").alias("_key"), F.col("at").alias("_at")), ["_key", "_at"], "left_semi")
            .dropDuplicates(["_key", "_at"]).drop("_key", "_at"))
