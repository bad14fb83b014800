"""Training-order materialisation of token ids.

Documents are encoded into fixed-length sequences, the sequences numbered
0..N-1 by (doc_id, text), and a keyed Feistel permutation with cycle-walking
maps each number to its global slot. Shards hold a contiguous slot range as
fixed-stride records, so slot s is at byte ``(s - first_slot) * stride`` and a
reader can stop and resume anywhere.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import arrow_schema, mix64, shared_table, to_batch
from ticketscope.llm.tokens import VOCABULARY, encoder, n_ids, vocabulary

ROUNDS = 6
#: doc_id (int64), chunk (int32) and token count (int32) before the ids of a record.
HEADER = np.dtype([("doc_id", "<i8"), ("chunk", "<i4"), ("n_tokens", "<i4")])
#: Stands for a null doc_id in a record header.
NO_ID = -(1 << 63)


def round_keys(key: str | bytes) -> list[int]:
    raw = key.encode() if isinstance(key, str) else key
    return [int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=bytes([r])).digest(), "little")
            for r in range(ROUNDS)]


def permute(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """Bijection of 0..n-1: a balanced Feistel network on the next even number
    of bits, repeated on values outside the domain (cycle-walking; at most four
    steps on average since the domain is over a quarter of the network's)."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ np.uint64(k)) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, seq_len: int, vocab: str = VOCABULARY) -> DataFrame:
    """``pid, k, doc_id, chunk, n_tokens, ids``: each text's ids and an end mark,
    cut every ``seq_len``; ``ids`` holds the chunk's ids without padding. A null
    or empty text is a sequence of the end mark alone.

    The text is range-partitioned and sorted by (doc_id, text hash), so
    partition by partition ``k`` counts the sequences in one global order that
    depends on the rows only. The table is written to the shared folder: shards
    and their numbers are made from it, not from a recomputation.
    """
    data = vocabulary(docs.sparkSession, vocab)
    schema = "pid int, k long, doc_id long, chunk int, n_tokens int, ids binary"
    _, target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, k = TaskContext.get().partitionId(), 0
        end = n_ids(data.value)
        width = np.uint16 if end < 1 << 16 else np.uint32
        enc = encoder(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                out = {f.name: [] for f in target}
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*(enc.encode_ordinary(t) if t else ()), end], width)
                    for c in range(0, len(ids), seq_len):
                        piece = ids[c:c + seq_len]
                        for name, v in zip(out, (pid, k, d, c // seq_len, len(piece), piece.tobytes())):
                            out[name].append(v)
                        k += 1
                yield to_batch(out, target)

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    order = [F.col("doc_id"), F.xxhash64("text")]
    return shared_table(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                        .mapInArrow(run, schema), "sequences")


def slots(seqs: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The sequences with their global ``slot``, and their number."""
    counts = seqs.groupBy("pid").agg(F.count("*").alias("n"))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    keys = round_keys(key)

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, keys))

    # one row per partition of the table: bounded by its task count, not by its rows
    at = seqs.join(F.broadcast(offsets), "pid")
    return at.withColumn("slot", slot(F.col("offset") + F.col("k"))).drop("pid", "k", "offset"), n


SHARD = ("shard long, first_slot long, n_sequences int, stride int, seq_len int, id_bytes int, "
         "crc32 long, payload binary")


def materialise(docs: DataFrame, key: str, seq_len: int = 512, shard_slots: int = 4096,
                vocab: str = VOCABULARY) -> DataFrame:
    """One row per shard of ``docs`` (doc_id, text) in training order.

    A record is the ``HEADER`` and ``seq_len`` ids (uint16, or uint32 for a
    vocabulary of 65,536 ids or more), short sequences padded with the end mark.
    Every shard but the last holds ``shard_slots`` records. Repeated rows are
    sequences of their own (ordered by text hash; equal rows are alike); a null
    doc_id is written as ``NO_ID``; no document, no shard. Extra columns are
    ignored. One shuffle of texts by id range, one of ids by shard range; a task
    holds one shard.
    """
    data = vocabulary(docs.sparkSession, vocab).value
    end = n_ids(data)
    width = np.uint16 if end < 1 << 16 else np.uint32
    record = np.dtype([*[(n, HEADER[n]) for n in HEADER.names], ("ids", width, (seq_len,))])
    at, _ = slots(sequences(docs, seq_len, vocab), key)
    _, target = arrow_schema(SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, filled = None, None, 0

        def shard():
            body = rows[:filled].tobytes()
            return to_batch({"shard": [now], "first_slot": [now * shard_slots], "n_sequences": [filled],
                             "stride": [record.itemsize], "seq_len": [seq_len],
                             "id_bytes": [np.dtype(width).itemsize], "crc32": [zlib.crc32(body)],
                             "payload": [body]}, target)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "doc_id", "chunk", "n_tokens", "ids")]
            for s, d, c, n, ids in zip(*cols):
                if s != now:
                    if filled:
                        yield shard()
                    now, rows, filled = s, np.full(shard_slots, 0, record), 0
                    rows["ids"] = end
                r = rows[filled]
                r["doc_id"], r["chunk"], r["n_tokens"] = NO_ID if d is None else d, c, n
                rows["ids"][filled, :n] = np.frombuffer(ids, width)
                filled += 1
        if filled:
            yield shard()

    sharded = at.withColumn("shard", F.floor(F.col("slot") / shard_slots).cast("long"))
    return (sharded.repartitionByRange("shard").sortWithinPartitions("shard", "slot")
            .select("shard", "doc_id", "chunk", "n_tokens", "ids").mapInArrow(run, SHARD))


READ = "slot long, doc_id long, chunk int, n_tokens int, ids array<int>"


def _record(id_bytes: int, seq_len: int) -> np.dtype:
    return np.dtype([*[(n, HEADER[n]) for n in HEADER.names], ("ids", np.uint16 if id_bytes == 2 else np.uint32, (seq_len,))])


def _slot_rows(rows: np.ndarray, first: int, target: pa.Schema) -> pa.RecordBatch:
    return to_batch({"slot": first + np.arange(len(rows)), "doc_id": [None if d == NO_ID else d for d in rows["doc_id"].tolist()],
                     "chunk": rows["chunk"], "n_tokens": rows["n_tokens"],
                     "ids": [r[:n].astype(np.int32) for r, n in zip(rows["ids"], rows["n_tokens"])]}, target)


def _in_range(shards: DataFrame, start: int, stop: int | None) -> DataFrame:
    part = shards.where(F.col("first_slot") + F.col("n_sequences") > start)
    return part if stop is None else part.where(F.col("first_slot") < stop)


def read_slots(shards: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Sequences of slots ``start`` to ``stop`` (exclusive; None: to the end) in
    slot order within each shard: only shards of that range are read, and in
    each one contiguous byte range. Padding is left out."""
    _, target = arrow_schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                first = max(0, start - x["first_slot"])
                last = x["n_sequences"] if stop is None else min(x["n_sequences"], stop - x["first_slot"])
                rows = np.frombuffer(x["payload"], _record(x["id_bytes"], x["seq_len"]), max(0, last - first), first * x["stride"])
                yield _slot_rows(rows, x["first_slot"] + first, target)

    return _in_range(shards, start, stop).mapInArrow(run, READ)


SUFFIX = ".bin"


def shard_name(shard: int) -> str:
    return f"shard-{shard:012d}{SUFFIX}"


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Shard files of ``materialise`` under ``folder``, and their index (``SHARD``
    without the payload, with the file's ``name``), also written there as Parquet.

    A file is the payload alone, so slot s of a shard stands at byte
    ``(s - first_slot) * stride``. A file is written under a name of its task
    attempt and then renamed, so that a repeated or lost task leaves whole files
    only; the index comes last and lists what to read. ``folder`` is any path that
    Hadoop's file systems or the tasks' own one can open: shared by all executors.
    No shard, no file and an empty index.
    """
    schema = "shard long, first_slot long, n_sequences int, stride int, seq_len int, id_bytes int, crc32 long, name string"
    _, target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        place, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        place.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for x in batch.to_pylist():
                name = shard_name(x["shard"])
                draft = f"{base}/.{name}.{attempt}"
                with place.open_output_stream(draft) as out:
                    out.write(x["payload"])
                place.move(draft, f"{base}/{name}")
                yield to_batch({f.name: [name if f.name == "name" else x[f.name]] for f in target}, target)

    index = f"{folder.rstrip('/')}/_index"
    shards.mapInArrow(run, schema).write.mode("overwrite").parquet(index)
    return shards.sparkSession.read.schema(schema).parquet(index)


def read_slots_from_files(index: DataFrame, folder: str, start: int = 0, stop: int | None = None,
                          block_slots: int = 256) -> DataFrame:
    """``read_slots`` on shard files: only files of the range are opened, each at
    the byte of its first wanted slot, and read on in blocks of ``block_slots``
    records; so a reader resumes at any slot without what stands before it."""
    _, target = arrow_schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        place, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for x in batch.to_pylist():
                kind = _record(x["id_bytes"], x["seq_len"])
                first = max(0, start - x["first_slot"])
                last = x["n_sequences"] if stop is None else min(x["n_sequences"], stop - x["first_slot"])
                with place.open_input_file(f"{base}/{x['name']}") as source:
                    source.seek(first * x["stride"])
                    for at in range(first, last, block_slots):
                        n = min(block_slots, last - at)
                        body = source.read(n * x["stride"])
                        if len(body) < n * x["stride"]:
                            raise ValueError(f"{x['name']} ends before slot {x['first_slot'] + at + n}")
                        yield _slot_rows(np.frombuffer(body, kind), x["first_slot"] + at, target)

    return _in_range(index, start, stop).mapInArrow(run, READ)
