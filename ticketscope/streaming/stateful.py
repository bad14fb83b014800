"""Keyed stream state: batches by count or timeout, running statistics, and a
listener over the queries' observed metrics."""

from __future__ import annotations

import json
import threading
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructField, StructType

BUFFER = StructType([StructField("rows", StringType()), StructField("batches", LongType())])
BATCH = "key string, batch_no long, fired string, n int, rows array<string>"


def st_count_or_timeout(stream: DataFrame, *, key: str, size: int = 10, timeout_seconds: float | None = 5.0,
                        order: list[str] | None = None) -> DataFrame:
    """Batches of ``size`` rows per key, or of whatever is there when no row has
    come for ``timeout_seconds``: (key, batch_no, fired, n, rows as JSON).

    ``fired`` is "count" or "timeout". A key's open batch (under ``size`` rows)
    is its state, so it survives restarts; the timer is a processing-time
    timeout, which a continuously running query fires without new data.
    ``timeout_seconds=None`` leaves it out, as an ``availableNow`` run needs: it
    would wait for timers without end. Rows of a micro-batch are taken in
    ``order``.
    """
    row = F.to_json(F.struct(*[F.col(c) for c in stream.columns]))
    src = stream.select(F.col(key).cast("string").alias("key"), row.alias("row"),
                        F.struct(*[F.col(c) for c in (order or [])], row.alias("_row")).alias("ord"))

    def fn(key, chunks, state):
        held, no = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        if timeout_seconds is not None and state.hasTimedOut:
            out, held = [("timeout", held)] if held else [], []
        else:
            new = [c for c in chunks if len(c)]
            if new:
                rows = pd.concat(new)
                ranks = rows["ord"].map(lambda o: tuple((v is not None, v) for v in (o.values() if isinstance(o, dict) else o)))
                held = held + [r for _, r in sorted(zip(ranks, rows["row"]))]
            full = len(held) // size
            out, held = [("count", held[i * size:(i + 1) * size]) for i in range(full)], held[full * size:]
        state.update((json.dumps(held), no + len(out)))
        if held and timeout_seconds is not None:
            state.setTimeoutDuration(int(timeout_seconds * 1000))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "batch_no": [no + i for i in range(len(out))],
                                "fired": [f for f, _ in out], "n": [len(r) for _, r in out], "rows": [r for _, r in out]})

    return src.groupBy("key").applyInPandasWithState(fn, BATCH, BUFFER, "append",
                                                     "NoTimeout" if timeout_seconds is None else "ProcessingTimeTimeout")


#: Updates that a task gives at a time: their rows overlap, each stands in several of them.
UPDATES = 1000
FEEDBACK = StructType([StructField("recent", StringType()), StructField("pending", LongType()), StructField("updates", LongType())])
UPDATE = "key string, update_no long, batch array<string>, recent array<string>"


def st_feedback_buffer(stream: DataFrame, *, key: str, frequency: int = 50, batch_size: int = 10, keep_batches: int = 5,
                       order: list[str] | None = None) -> DataFrame:
    """Model updates from buffered feedback: (key, update_no, batch, recent), rows as JSON.

    Feedback waits until ``frequency`` rows of a key are pending; then the oldest
    ``batch_size`` of them are an update's ``batch``, and ``recent`` are the last
    ``batch_size * keep_batches`` rows received, for a model that is refitted
    whole. The rest stays pending, so later updates follow every ``batch_size``
    rows. State of a key is its last rows (at most ``frequency`` or the recent
    ones, whichever is more) and two counters. Rows of a micro-batch are taken in
    ``order``.
    """
    if not 0 < batch_size <= frequency:
        raise ValueError("batch_size must be between 1 and frequency")
    row = F.to_json(F.struct(*[F.col(c) for c in stream.columns]))
    src = stream.select(F.col(key).cast("string").alias("key"), row.alias("row"),
                        F.struct(*[F.col(c) for c in (order or [])], row.alias("_row")).alias("ord"))
    window = batch_size * keep_batches

    def fn(key, chunks, state):
        held, pending, no = (json.loads(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], 0, 0)
        new = [c for c in chunks if len(c)]
        if not new:
            return
        rows = pd.concat(new)
        ranks = rows["ord"].map(lambda o: tuple((v is not None, v) for v in (o.values() if isinstance(o, dict) else o)))
        seen = len(held)
        held = held + [r for _, r in sorted(zip(ranks, rows["row"]))]
        out = []
        at = seen + frequency - pending  # rows held when the next update is due
        while at <= len(held):
            first = at - frequency
            out.append((key[0], no, held[first:first + batch_size], held[max(0, at - window):at]))
            at, pending, no = at + batch_size, pending - batch_size, no + 1
            if len(out) == UPDATES:
                yield pd.DataFrame(out, columns=["key", "update_no", "batch", "recent"])
                out = []
        pending += len(held) - seen
        state.update((json.dumps(held[-max(window, pending):]), pending, no))
        if out:
            yield pd.DataFrame(out, columns=["key", "update_no", "batch", "recent"])

    return src.groupBy("key").applyInPandasWithState(fn, UPDATE, FEEDBACK, "append", "NoTimeout")


def nb_refits(updates: DataFrame, row_schema: str, *, text_col: str = "text", label_col: str = "true_category") -> DataFrame:
    """Naive Bayes counts refitted on each update's recent rows: (key, update_no,
    class, term, n), the term '' counting documents."""
    from ticketscope.streaming.jobs import nb_tokens
    rows = updates.select("key", "update_no", F.explode("recent").alias("r")).select(
        "key", "update_no", F.from_json("r", row_schema).alias("r"))
    terms = F.array_append(F.coalesce(nb_tokens(F.col(f"r.{text_col}")), F.array().cast("array<string>")), "")
    return rows.select("key", "update_no", F.col(f"r.{label_col}").alias("class"), F.explode(terms).alias("term")).groupBy(
        "key", "update_no", "class", "term").agg(F.count("*").alias("n"))


RUNNING = StructType([StructField(n, LongType()) for n in ("total", "errors", "first", "last")]
                     + [StructField("average", StringType())])
STATS = ("key string, total_processed long, total_errors long, avg_processing_time_ms double, uptime_seconds double, "
         "throughput_per_second double")


def st_running_stats(stream: DataFrame, *, key: str, ts: str = "ts", value: str = "processing_time_ms", error: str = "is_error",
                     order: list[str] | None = None, alpha: float = 0.1) -> DataFrame:
    """Totals, errors, moving average, uptime and throughput per key, kept as state;
    one row per key and micro-batch that has rows of it (update mode).

    The average starts at the first value and moves by ``alpha`` with every
    further one, in the order of ``ts`` (then ``order``) within a micro-batch; a
    micro-batch enters it in closed form, not row by row.
    """
    src = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
                        F.col(value).cast("double").alias("x"), F.coalesce(F.col(error).cast("boolean"), F.lit(False)).alias("bad"),
                        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order or [])])
    by = ["at", *[f"o{i}" for i in range(len(order or []))]]

    def fn(key, chunks, state):
        total, errors, first, last, average = state.get if state.exists else (0, 0, None, None, None)
        new = [c for c in chunks if len(c)]
        if not new:
            return
        rows = pd.concat(new).sort_values(by, kind="stable")
        x = rows["x"].to_numpy(float)
        start = float(average) if average is not None else x[0]
        moved = x if average is not None else x[1:]
        weights = alpha * (1 - alpha) ** np.arange(len(moved) - 1, -1, -1)
        mean = float((1 - alpha) ** len(moved) * start + weights @ moved)
        at = rows["at"].to_numpy()
        total, errors = total + len(rows), errors + int(rows["bad"].sum())
        first = int(at.min()) if first is None else min(first, int(at.min()))
        last = int(at.max()) if last is None else max(last, int(at.max()))
        state.update((total, errors, first, last, repr(mean)))
        up = (last - first) / 1e6
        yield pd.DataFrame({"key": [key[0]], "total_processed": [total], "total_errors": [errors], "avg_processing_time_ms": [mean],
                            "uptime_seconds": [up], "throughput_per_second": [total / up if up else None]})

    return src.groupBy("key").applyInPandasWithState(fn, STATS, RUNNING, "update", "NoTimeout")


class StreamStats(StreamingQueryListener):
    """Live statistics of a session's running queries from their progress reports.

    A query that carries ``watched(source)`` reports rows and errors of each
    micro-batch as observed metrics; the listener only adds them up on the
    driver. Register with ``spark.streams.addListener(stats)``.
    """

    NAME = "stream_stats"

    def __init__(self, alpha: float = 0.1):
        self._lock, self._queries, self._alpha = threading.Lock(), {}, alpha

    @staticmethod
    def watched(df: DataFrame, error=None) -> DataFrame:
        """``df`` with the observed metrics that the listener reads (``error``: a condition)."""
        bad = F.lit(False) if error is None else error
        return df.observe(StreamStats.NAME, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("errors"))

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._queries[str(event.runId)] = {"name": event.name, "start": time.monotonic(), "end": None, "batches": 0, "failed": None,
                                               "total_processed": 0, "total_errors": 0, "avg_processing_time_ms": None}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = (p.observedMetrics or {}).get(self.NAME)
        with self._lock:
            q = self._queries.get(str(p.runId))
            if q is None or seen is None or not seen["rows"]:
                return
            per_row = p.batchDuration / seen["rows"]
            before = q["avg_processing_time_ms"]
            q["avg_processing_time_ms"] = per_row if before is None else self._alpha * per_row + (1 - self._alpha) * before
            q["batches"] += 1
            q["total_processed"] += seen["rows"]
            q["total_errors"] += seen["errors"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            q = self._queries.get(str(event.runId))
            if q is not None:
                q["end"], q["failed"] = time.monotonic(), event.exception

    def stats(self) -> list[dict]:
        """One entry per query: totals, average, uptime, throughput and whether it runs."""
        out = []
        with self._lock:
            for run_id, q in self._queries.items():
                up = (q["end"] or time.monotonic()) - q["start"]
                out.append({"run_id": run_id, "name": q["name"], "batches": q["batches"], "total_processed": q["total_processed"],
                            "total_errors": q["total_errors"], "avg_processing_time_ms": q["avg_processing_time_ms"],
                            "uptime_seconds": up, "throughput_per_second": q["total_processed"] / up if up else 0.0,
                            "is_running": q["end"] is None, "failed": q["failed"]})
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        kind = ("run_id string, name string, batches long, total_processed long, total_errors long, avg_processing_time_ms double, "
                "uptime_seconds double, throughput_per_second double, is_running boolean, failed string")
        return spark.createDataFrame([tuple(s.values()) for s in self.stats()], kind)
