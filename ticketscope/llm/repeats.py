"""Exact removal of repeated byte strings by bucket-pointer refinement.

Every byte covered by a string of ``length`` bytes that also starts earlier in
the corpus goes. Positions are sorted into buckets by their first q bytes;
buckets of one pointer leave; the others are refined by the bucket identifiers
of later offsets, each refinement reusing the identifiers of the last
(q, 2q, 4q, .. bytes deep) until buckets are ``length`` bytes deep. A bucket's
smallest pointer (doc_id, start) is its first occurrence; all others repeat it.

Not every position needs a row of its own. In any ``length`` bytes the q-gram of
least hash (the leftmost, on ties) is determined by the bytes alone, so equal
strings have it at equal offsets. Strings that start in a row and share that
q-gram form a run with one pointer, about one per 30 positions:

1. q-gram buckets of the runs are counted; buckets of one pointer leave.
2. Runs left are refined by the identifiers of the strings they begin and end
   with, which cover all their bytes. Equal runs repeat each other whole.
3. Buckets that hold different runs are refined down to single strings: their
   runs travel with their bytes, once each, and every bucket is sorted by the
   identifiers of later offsets until it is ``length`` bytes deep. There an
   identifier is a rank, so this step compares bytes. A bucket of more than
   ``HOT`` different runs is not gathered: its strings are dealt by identifier.

In the first two steps identifiers are hashes (of 64 and 128 bits), so buckets
are formed by a shuffle instead of a global rank. Each task first settles its
own rows, so that a string that very many documents share is one row per task.
The sets "more than one pointer" and "different runs" go back to the scan as
bitmaps sized by the corpus up to ``MOST_BITS``: a false hit costs a row, never a
wrong answer.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.llm.common import SLICE_ROWS, arrow_schema, bitmap, in_bitmap, map_arrow, mix64, shared_table, texts, to_batch

#: Bits of a bitmap, as powers of two: eight per expected run, 8 MB at least and 64 MB at most.
LEAST_BITS, MOST_BITS = 26, 29
#: Different runs of a bucket that one task may gather with their bytes.
HOT = 8192
#: Rows that a task settles at a time.
SETTLE_ROWS = 1 << 20
#: String starts of a text hashed at a time (as a power of two).
CHUNK_BITS = 18
#: Stands for a null doc_id; it precedes every id.
NO_ID = -(1 << 63)
#: A pointer: start of the run, 7 bits of the run's length.
RUN_BITS = 7
FACTOR = 0x9E3779B97F4A7C15
ONE = np.uint64(1)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit value per byte; powers of an odd factor and of its inverse."""
    n = (1 << CHUNK_BITS) + 1024
    byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    power = np.full(n, FACTOR, np.uint64)
    back = np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    return byte, np.multiply.accumulate(power), np.multiply.accumulate(back)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width``: running minima to and from block borders."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    forth = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], forth[width - 1:n])


class Runs:
    """Runs of one piece of a text: ``bucket`` (q-gram identifier), ``start`` and
    ``size`` (string starts), and identifiers of whole runs or single strings."""

    def __init__(self, piece: np.ndarray, length: int, q: int):
        byte, power, back = _tables()
        n = len(piece)
        self.piece = piece
        self.length, self.q, self.back = length, q, back
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[piece] * power[:n], out=self.sums[1:])
        self.ids = mix64((self.sums[q:] - self.sums[:-q]) * back[:n - q + 1])
        low = np.uint64((1 << 20) - 1)
        least = _sliding_min((self.ids & ~low) | np.arange(len(self.ids), dtype=np.uint64), length - q + 1)
        owner = (least & low).astype(np.int64)
        self.start = np.flatnonzero(np.diff(owner, prepend=-1))
        self.size = np.diff(self.start, append=len(owner))
        self.bucket = self.ids[owner[self.start]]

    def whole(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two identifiers of all bytes of the runs ``on``: of their bytes, and of
        the strings that they begin and end with."""
        start, size = self.start[on], self.size[on]
        end = start + size - 1
        h = (self.sums[end + self.length] - self.sums[start]) * self.back[start]
        single = self.single()
        return (mix64(mix64(h) ^ (self.bucket[on] * np.uint64(FACTOR)) ^ size.astype(np.uint64)),
                mix64(single[start] * np.uint64(FACTOR) + single[end]) ^ size.astype(np.uint64))

    def single(self) -> np.ndarray:
        """Identifier of the string at every start: refined from q bytes by those of later offsets."""
        ids, depth = self.ids, self.q
        while depth < self.length:
            step = min(depth, self.length - depth)
            ids = mix64(ids[:-step] * np.uint64(FACTOR) + ids[step:])
            depth += step
        return ids


def _pieces(batch: pa.RecordBatch, length: int, q: int) -> Iterator[tuple[int, int, int, Runs]]:
    """``doc_id, checksum, offset, runs`` of every piece of every text."""
    size = 1 << CHUNK_BITS
    for d, tag, t in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), texts(batch)):
        b = np.frombuffer(t, np.uint8)
        for at in range(0, len(b) - length + 1, size):
            yield (NO_ID if d is None else d), tag, at, Runs(b[at:at + size + length - 1], length, q)


CONTEND = "bucket long, id long, id2 long, doc_id long, tag long, pointer long, stop long"
SPAN = "doc_id long, tag long, start long, stop long"


def _settle(bucket, ids, id2, doc, tag, pointer, length: int) -> Iterator[dict]:
    """A task's own verdict on its rows: the first pointer of each identifier
    contends with other tasks; later ones repeat it and become merged byte spans
    (rows with ``stop``)."""
    if not ids:
        return
    cols = [np.concatenate(x) for x in (bucket, ids, id2, doc, tag, pointer)]
    order = np.lexsort((cols[5], cols[3], cols[2], cols[1]))
    bucket, ids, id2, doc, tag, pointer = (x[order] for x in cols)
    head = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (id2[1:] != id2[:-1])))
    first = np.repeat(head, np.diff(head, append=len(ids)))
    start = pointer >> RUN_BITS
    late = (doc != doc[first]) | (start != start[first])  # equal places under one doc_id: neither is earlier
    on = ~late
    yield {"bucket": bucket[on].view(np.int64), "id": ids[on].view(np.int64), "id2": id2[on].view(np.int64), "doc_id": doc[on],
           "tag": tag[on], "pointer": pointer[on], "stop": pa.nulls(int(on.sum()), pa.int64())}
    doc, tag, start, size = doc[late], tag[late], start[late], pointer[late] & (1 << RUN_BITS) - 1
    if not len(doc):
        return
    doc, tag, start, stop = _joined(doc, tag, start, start + size - 1 + length)
    yield {"bucket": pa.nulls(len(doc), pa.int64()), "id": _key(doc, tag, start).view(np.int64), "id2": np.zeros(len(doc), np.int64),
           "doc_id": doc, "tag": tag, "pointer": start << RUN_BITS, "stop": stop}


def _joined(doc, tag, start, stop):
    """Spans of a text that touch, as one."""
    if not len(doc):
        return doc, tag, start, stop
    order = np.lexsort((start, tag, doc))
    doc, tag, start, stop = doc[order], tag[order], start[order], stop[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > stop[:-1]))[:len(doc)]
    at = np.flatnonzero(new)
    return doc[at], tag[at], start[at], stop[np.append(at[1:], len(new)) - 1]


def _key(doc: np.ndarray, tag: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    return mix64(mix64(mix64(doc.view(np.uint64)) ^ tag.view(np.uint64)) ^ pointer.view(np.uint64))


def _later(rows: DataFrame) -> DataFrame:
    """``rows`` of ``CONTEND`` with ``repeats``: whether an equal identifier starts
    earlier. After ``_settle`` an identifier has a few rows per task at most."""
    first = F.min(F.struct("doc_id", "pointer")).over(Window.partitionBy("id", "id2"))
    start = F.shiftright(F.col("pointer"), RUN_BITS)
    later = (F.col("doc_id") > F.col("first.doc_id")) | (
        (F.col("doc_id") == F.col("first.doc_id")) & (start > F.shiftright(F.col("first.pointer"), RUN_BITS)))
    return (rows.withColumn("first", first)
            .withColumn("repeats", F.col("stop").isNotNull() | later).drop("first", "id", "id2"))


def _spans(rows: DataFrame, length: int) -> DataFrame:
    """``SPAN`` of repeated rows."""
    start = F.shiftright(F.col("pointer"), RUN_BITS)
    size = F.col("pointer").bitwiseAND((1 << RUN_BITS) - 1)
    return rows.where("repeats").select("doc_id", "tag", start.alias("start"), F.coalesce("stop", start + size - 1 + length).alias("stop"))


def _bits(docs: DataFrame) -> int:
    """Bitmap size for the corpus: eight bits per 30 bytes of text."""
    n = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(8 * n / 30).bit_length()))


def refine(bucket: np.ndarray, runs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of the runs: its run, its place in the run, and the rank of
    its bytes within its bucket. Buckets of eight bytes are refined by the ranks
    of later offsets, each step reusing the ranks of the one before."""
    size = np.array([len(r) for r in runs], np.int64)
    data = np.frombuffer(b"".join(runs) + bytes(8), np.uint8)
    low = np.zeros(len(data) - 8, np.uint64)
    for k in range(8):
        low = (low << np.uint64(8)) | data[k:len(low) + k]
    rank, depth = np.unique(low, return_inverse=True)[1].astype(np.int64), 8
    while depth < length:
        step = min(depth, length - depth)
        later = np.append(rank[step:], np.zeros(step, np.int64))  # past a run's end: its strings end before
        rank = np.unique(rank * (rank.max() + 1) + later, return_inverse=True)[1].astype(np.int64)
        depth += step
    begin = np.cumsum(size) - size
    strings = size - length + 1
    run = np.repeat(np.arange(len(runs)), strings)
    place = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    rank = rank[begin[run] + place]
    own = np.unique(bucket, return_inverse=True)[1].astype(np.int64)[run]
    return run, place, own * (rank.max() + 1 if len(rank) else 1) + rank


def repeated_spans(docs: DataFrame, length: int = 100, q: int = 32) -> DataFrame:
    """``doc_id, tag, spans``: byte spans [start, stop) of each text that strings
    of ``length`` bytes cover which start earlier too; spans may overlap."""
    if not 0 < q <= length < q + (1 << RUN_BITS) or length < 8:
        raise ValueError("q must be at most length and above length - 128, length 8 at least")
    spark = docs.sparkSession
    rows = docs.select("doc_id", "tag", "text")
    bits = _bits(rows)
    _, target = arrow_schema(CONTEND)

    def buckets(batch: pa.RecordBatch):
        found = [r.bucket for *_, r in _pieces(batch, length, q)]
        if found:
            yield {"bucket": np.concatenate(found).view(np.int64)}

    shared = (map_arrow(rows, buckets, "bucket long").groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    many = spark.sparkContext.broadcast(bitmap(shared, "bucket", bits))

    def contend(pick) -> callable:
        """A scan that settles the rows ``pick`` finds in each piece, ``SETTLE_ROWS`` at a time."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: tuple = ([], [], [], [], [], [])
            held = 0
            for batch in batches:
                for a in range(0, batch.num_rows, SLICE_ROWS):
                    for d, tag, at, r in _pieces(batch.slice(a, SLICE_ROWS), length, q):
                        bucket, ids, id2, start, size = pick(d, tag, at, r)
                        if not len(ids):
                            continue
                        held += len(ids)
                        for x, v in zip(out, (bucket, ids, id2, np.full(len(ids), d, np.int64), np.full(len(ids), tag, np.int64),
                                              (start + at << RUN_BITS) | size)):
                            x.append(v)
                    if held >= SETTLE_ROWS:
                        for cols in _settle(*out, length):
                            yield to_batch(cols, target)
                        out, held = ([], [], [], [], [], []), 0
            for cols in _settle(*out, length):
                yield to_batch(cols, target)
        return run

    none = np.zeros(0, np.uint64)

    def whole_runs(d, tag, at, r):
        on = np.flatnonzero(in_bitmap(many.value, r.bucket))
        if not len(on):
            return none, none, none, none, none
        return r.bucket[on], *r.whole(on), r.start[on], r.size[on]

    runs = shared_table(_later(rows.mapInArrow(contend(whole_runs), CONTEND)), "runs")
    first = runs.where(~F.col("repeats")).select("bucket", "doc_id", "tag", "pointer")
    unlike = first.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    unlike = shared_table(unlike, "buckets")

    @F.pandas_udf("long")
    def key(doc: pd.Series, tag: pd.Series, pointer: pd.Series) -> pd.Series:
        return pd.Series(_key(doc.to_numpy(), tag.to_numpy(), pointer.to_numpy()).view(np.int64))

    def open_runs(which) -> tuple:
        own = unlike.where(which).select("bucket")
        keys = first.join(own, "bucket").select(key("doc_id", "tag", "pointer").alias("key"))
        return spark.sparkContext.broadcast(bitmap(own, "bucket", bits)), spark.sparkContext.broadcast(bitmap(keys, "key", bits))

    def undecided(maps, d, tag, at, r) -> np.ndarray:
        on = np.flatnonzero(in_bitmap(maps[0].value, r.bucket))
        if len(on):
            n = len(on)
            keys = _key(np.full(n, d, np.int64), np.full(n, tag, np.int64), (r.start[on] + at << RUN_BITS) | r.size[on])
            on = on[in_bitmap(maps[1].value, keys)]
        return on

    few, lots = open_runs(f"n <= {HOT}"), f"n > {HOT}"
    carried = "bucket long, doc_id long, tag long, start long, bytes binary"

    def with_bytes(batch: pa.RecordBatch):
        for d, tag, at, r in _pieces(batch, length, q):
            on = undecided(few, d, tag, at, r)
            if len(on):
                a, b = r.start[on], r.start[on] + r.size[on] - 1 + length
                n = len(on)
                yield {"bucket": r.bucket[on].view(np.int64), "doc_id": np.full(n, d, np.int64), "tag": np.full(n, tag, np.int64),
                       "start": a + at, "bytes": [r.piece[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]}

    _, span = arrow_schema(SPAN)

    def refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def verdicts(t: pa.RecordBatch) -> pa.RecordBatch:
            doc, tag, start = (t.column(c).to_numpy() for c in ("doc_id", "tag", "start"))
            run, place, rank = refine(t.column("bucket").to_numpy(), t.column("bytes").to_pylist(), length)
            at = start[run] + place
            order = np.lexsort((at, doc[run], rank))
            run, at, rank = run[order], at[order], rank[order]
            head = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])[:len(rank)])
            least = np.repeat(head, np.diff(head, append=len(rank)))
            late = (doc[run] != doc[run[least]]) | (at != at[least])
            run, at = run[late], at[late]
            return to_batch(dict(zip(("doc_id", "tag", "start", "stop"), _joined(doc[run], tag[run], at, at + length))), span)

        for batch in batches:
            for a in range(0, batch.num_rows, HOT):
                part = batch.slice(a, HOT)
                held.append(part)
                # whole buckets only: up to the last change of bucket
                if sum(x.num_rows for x in held) >= HOT:
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    b = t.column("bucket").to_numpy()
                    edges = np.flatnonzero(b[1:] != b[:-1]) + 1
                    if len(edges):
                        yield verdicts(t.slice(0, int(edges[-1])))
                        t = t.slice(int(edges[-1]))
                    held = [t]
        if held and sum(x.num_rows for x in held):
            yield verdicts(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    gathered = map_arrow(rows, with_bytes, carried).repartition("bucket").sortWithinPartitions("bucket")
    spans = _spans(runs, length).unionByName(gathered.mapInArrow(refined, SPAN))
    if unlike.where(lots).limit(1).count():
        hot = open_runs(lots)

        def single_strings(d, tag, at, r):
            on = undecided(hot, d, tag, at, r)
            if not len(on):
                return none, none, none, none, none
            n = r.size[on]
            p = np.repeat(r.start[on] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            again = (r.sums[p + length] - r.sums[p]) * r.back[p]
            return np.repeat(r.bucket[on], n), r.single()[p], mix64(again), p, np.ones(len(p), np.int64)

        spans = spans.unionByName(_spans(_later(rows.mapInArrow(contend(single_strings), CONTEND)), length))
    return spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the spans' union, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def _tagged(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text")).withColumn(
        "tag", F.xxhash64("text"))


def find_repeats(docs: DataFrame, length: int = 100, q: int = 32) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row
    of ``docs`` (doc_id, text): removed byte runs and the digest of the rest.

    Strings are judged on the input, within one text each. Null and empty texts
    have no byte. Rows that share a doc_id, or have none, count as one document
    whose equal starts do not precede each other (so repeated rows keep their
    first occurrences and give equal results). Extra columns are ignored. Texts
    are scanned four times; only pointers are shuffled, and the texts that lose
    bytes once.
    """
    spark = docs.sparkSession
    rows = _tagged(docs)
    spans = shared_table(repeated_spans(rows, length, q), "spans")

    def text_key(doc: pd.Series, tag: pd.Series) -> np.ndarray:
        return mix64(mix64(doc.to_numpy(np.int64).view(np.uint64)) ^ tag.to_numpy(np.int64).view(np.uint64))

    @F.pandas_udf("long")
    def key(doc: pd.Series, tag: pd.Series) -> pd.Series:
        return pd.Series(text_key(doc, tag).view(np.int64))

    cut_docs = spark.sparkContext.broadcast(
        bitmap(spans.select(key("doc_id", "tag").alias("key")), "key", LEAST_BITS))

    @F.pandas_udf("boolean")
    def may_lose(doc: pd.Series, tag: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(cut_docs.value, text_key(doc, tag)))

    own = F.coalesce("doc_id", F.lit(NO_ID))
    sure = rows.where(~may_lose(own, "tag")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        F.lit([]).cast("array<struct<start:long,stop:long>>").alias("spans"))

    def cut_out(batch: pa.RecordBatch):
        out = {k.split()[0]: [] for k in RESULT.split(", ")}
        for d, t, s in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("spans").to_pylist()):
            gone = merged(s or [])
            edges = [0, *(x for ab in gone for x in ab), len(t)]
            digest = hashlib.sha256()
            for a, b in zip(edges[::2], edges[1::2]):
                digest.update(t[a:b])
            for x, v in zip(out.values(), (d, len(t), sum(b - a for a, b in gone), len(gone), digest.hexdigest(),
                                           [{"start": a, "stop": b} for a, b in gone])):
                x.append(v)
        yield out

    found = spans.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "spans")
    touched = rows.where(may_lose(own, "tag")).join(
        found, (own == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("doc_id", "text", "spans")
    return sure.unionByName(map_arrow(touched, cut_out, RESULT))
