"""Alignment of two tokenizers: token pairs whose bytes overlap, counted over the corpus.

Every link holds a pair of ids (B id, A id). A run covers the documents of one
slice: its pair-document records, ordered side-major (B id, then A id), are
dealt by radix of the B id into parts and kept as zstd frames in the shared
folder. Per part, heap merges of at most ``FAN`` runs each, level upon level,
count every pair; in the last run's order all pairs of a B id are neighbours,
which gives their highest count. The counts then meet the runs again, some runs
of one part at a time, and stream each document's sums back.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.llm.common import arrow_schema, shared_table, to_batch
from ticketscope.llm.tokens import MAX_VOCABULARY_BYTES, PATTERN

#: Default places of the vocabularies (parameters of the operator).
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Parts that B ids are dealt into, by their low bits.
PARTS = 16
#: Runs that one merge reads.
FAN = 64
#: Text bytes and rows that a run's slice ends at (a longer document stands alone).
RUN_BYTES, RUN_ROWS = 2 << 20, 4096
#: Records of a frame.
FRAME = 1 << 14
#: A pair's key is its B id above its A id.
A_BITS = 20


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary above {MAX_VOCABULARY_BYTES} bytes")
    return data


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_encoder(data: bytes) -> tuple[tiktoken.Encoding, list[bytes]]:
    """Encoder of a byte-level BPE file without its special tokens, and the bytes of each id.

    The file's merges must make the ids in order, so that an id is its rank.
    """
    spec = json.loads(data)
    special = {t["content"] for t in spec["added_tokens"]}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    for k, merge in enumerate(spec["model"]["merges"]):
        pair = merge.split(" ") if isinstance(merge, str) else merge
        if ranks.get(bytes(alphabet[c] for c in "".join(pair))) != 256 + k:
            raise ValueError("ids are not in the order of the merges")
    entries = [b""] * (1 + max(ranks.values()))
    for t, i in ranks.items():
        entries[i] = t
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), entries


@lru_cache(maxsize=2)
def piece_encoder(data: bytes) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """Encoder of a piece model, and the bytes of each id (controls have none)."""
    model = sentencepiece.SentencePieceProcessor(model_proto=data)

    def entry(i: int) -> bytes:
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[3:5], 16)])
        if model.is_control(i) or model.is_unknown(i):
            return b""
        return model.id_to_piece(i).replace("▁", " ").encode()

    return model, [entry(i) for i in range(model.get_piece_size())]


def pack(*columns: np.ndarray) -> bytes:
    """Frames of at most ``FRAME`` records: a length, then the zstd bytes of the
    columns (the first one sorted, kept as differences)."""
    zip_ = zstandard.ZstdCompressor(level=3)
    out = []
    for at in range(0, len(columns[0]), FRAME):
        part = [c[at:at + FRAME].astype(np.int64) for c in columns]
        part[0] = np.diff(part[0], prepend=0)
        # byte planes: the high bytes are nearly all zero
        planes = np.concatenate(part).view(np.uint8).reshape(-1, 8).T
        frame = zip_.compress(planes.tobytes())
        out += [len(frame).to_bytes(4, "little"), frame]
    return b"".join(out)


def unpack(blob: bytes, n_columns: int) -> Iterator[np.ndarray]:
    """The frames of ``pack``, one array of shape (columns, records) at a time."""
    unzip, at = zstandard.ZstdDecompressor(), 0
    while at < len(blob):
        size = int.from_bytes(blob[at:at + 4], "little")
        raw = unzip.decompress(blob[at + 4:at + 4 + size])
        part = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).reshape(n_columns, -1)
        part[0] = np.cumsum(part[0])
        yield part
        at += 4 + size


def whole(blob: bytes, n_columns: int) -> np.ndarray:
    frames = list(unpack(blob, n_columns))
    return np.concatenate(frames, 1) if frames else np.zeros((n_columns, 0), np.int64)


def merged(blobs: Iterable[bytes]) -> Iterator[tuple[int, int]]:
    """``(key, count)`` of each key in ascending order over runs of (key, count): a heap merge, a frame of each run at a time."""

    def records(blob: bytes) -> Iterator[tuple[int, int]]:
        for keys, counts in unpack(blob, 2):
            yield from zip(keys.tolist(), counts.tolist())

    key, total = -1, 0
    for k, n in heapq.merge(*map(records, blobs)):
        if k == key:
            total += n
        else:
            if key >= 0:
                yield key, total
            key, total = k, n
    if key >= 0:
        yield key, total


def merge_run(blobs: Iterable[bytes]) -> bytes:
    """One run from several; holds a frame of each and a frame of the result."""
    out: list[bytes] = []
    keys: list[int] = []
    counts: list[int] = []
    for k, n in merged(blobs):
        keys.append(k)
        counts.append(n)
        if len(keys) == FRAME:
            out.append(pack(np.array(keys), np.array(counts)))
            keys, counts = [], []
    if keys:
        out.append(pack(np.array(keys), np.array(counts)))
    return b"".join(out)


def align(a_ids: list[list[int]], b_ids: list[list[int]], a_size: np.ndarray, b_size: np.ndarray) -> dict:
    """Groups and links of several documents whose A and B tokens cover the same bytes.

    Ends of tokens are counted on one line of bytes over all documents. Each
    stretch between neighbouring ends lies in one A and one B token and is their
    link; an end of both closes a group.
    """
    a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, b_ids))
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    line = np.zeros((2, int(a_end[-1]) + 1 if len(a) else 1), np.int32)
    line[0, a_end] = line[1, b_end] = 1
    ends, both = np.flatnonzero(line[0] | line[1]), np.flatnonzero(line[0] & line[1])
    before_a, before_b = np.cumsum(line, 1, dtype=np.int32) - line  # tokens that end earlier
    line[0] &= line[1]
    groups = np.cumsum(line[0]) - line[0]
    last = np.concatenate(([0], a_end))[np.cumsum([len(x) for x in a_ids])]  # where each document's bytes end
    of = np.arange(len(a_ids))

    def document(at: np.ndarray) -> np.ndarray:
        return np.repeat(of, np.diff(np.searchsorted(at, last, "right"), prepend=0))

    return {"a": a, "b": b, "a_group": groups[a_end], "b_group": groups[b_end],
            "keys": (b[before_b[ends]] << A_BITS) | a[before_a[ends]], "link_doc": document(ends),
            "group_doc": document(both)}


class Spelling:
    """Ids as text with what follows them: ``,`` inside a side, ``|`` after A's last, ``;`` after B's last of a group."""

    def __init__(self, n: int):
        self.text = np.array([[f"{i}{sep}" for i in range(n)] for sep in ",|;"], object)

    def groups(self, got: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts of all tokens in the order of the groups, A before B; where each A and B token stands."""
        a_group, b_group = got["a_group"], got["b_group"]
        n_a, n_b = len(a_group), len(b_group)
        # tokens before: all of the own side, and the other side's of earlier (B: also this) groups
        a_at = np.arange(n_a) + np.searchsorted(b_group, a_group, "left")
        b_at = np.arange(n_b) + np.searchsorted(a_group, b_group, "right")
        a_last = np.append(a_group[1:] != a_group[:-1], True)[:n_a]
        b_last = np.append(b_group[1:] != b_group[:-1], True)[:n_b]
        out = np.empty(n_a + n_b, object)
        out[a_at] = self.text[a_last.astype(int), got["a"]]
        out[b_at] = self.text[2 * b_last.astype(int), got["b"]]
        return out, a_at, b_at


RUN_SCHEMA = ("run long, part int, keys binary, places binary, doc_ids array<long>, n_a array<long>, n_b array<long>, "
              "n_groups array<long>, n_links array<long>, groups_sha256 array<string>, groups array<string>")


def encode_slice(doc_ids: list, texts: list[str | None], a_data: bytes, b_data: bytes, with_groups: bool) -> Iterator[dict]:
    """The run of one slice: a row with its documents' counts (part -1) and a row for each part."""
    enc, a_entry = byte_encoder(a_data)
    model, b_entry = piece_encoder(b_data)
    n = len(texts)
    a_ids: list[list[int]] = [[] for _ in texts]
    b_ids: list[list[int]] = [[] for _ in texts]
    given = [k for k, t in enumerate(texts) if t]
    for k, b in zip(given, model.encode([texts[k] for k in given], num_threads=1) if given else []):
        text = " " + texts[k]
        a, raw = enc.encode_ordinary(text), text.encode()
        if b"".join([a_entry[i] for i in a]) == raw and b"".join([b_entry[i] for i in b]) == raw:
            a_ids[k], b_ids[k] = a, b
    sizes = [np.array([len(t) for t in e], np.int64) for e in (a_entry, b_entry)]
    got = align(a_ids, b_ids, *sizes)
    spelled, a_at, b_at = spelling(max(len(a_entry), len(b_entry))).groups(got)
    tokens = np.concatenate(([0], np.cumsum([len(x) + len(y) for x, y in zip(a_ids, b_ids)])))
    groups = ["".join(spelled[tokens[k]:tokens[k + 1]])[:-1] for k in range(n)]
    yield {"part": -1, "keys": None, "places": None, "doc_ids": doc_ids,
           "n_a": [len(x) for x in a_ids], "n_b": [len(x) for x in b_ids],
           "n_groups": np.bincount(got["group_doc"], minlength=n).tolist(),
           "n_links": np.bincount(got["link_doc"], minlength=n).tolist(),
           "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups],
           "groups": groups if with_groups else None}
    # pair-document records: pair, then document, with the links they stand for
    order = np.argsort(got["keys"], kind="stable")  # links stand in the order of the documents
    keys, docs = got["keys"][order], got["link_doc"][order]
    new_key = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
    new = new_key | np.append(True, docs[1:] != docs[:-1])[:len(keys)]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys)))
    keys, docs = keys[at], docs[at]
    part = (keys >> A_BITS) % PARTS
    for p in range(PARTS):
        own = part == p
        if own.any():
            k, first = np.unique(keys[own], return_index=True)
            pair = np.searchsorted(k, keys[own])
            yield {"part": p, "keys": pack(k, np.add.reduceat(times[own], first)),
                   "places": pack(pair, docs[own], times[own])} | dict.fromkeys(
                       ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"))


@lru_cache(maxsize=1)
def spelling(n: int) -> Spelling:
    return Spelling(n)


def write_runs(docs: DataFrame, a_path: str, b_path: str, with_groups: bool) -> DataFrame:
    """Encode all documents once; the runs, as a table in the shared folder."""
    context = docs.sparkSession.sparkContext
    a_data, b_data = context.broadcast(load(a_path)), context.broadcast(load(b_path))
    _, target = arrow_schema(RUN_SCHEMA.removeprefix("run long, "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list = []
        held: list = []
        size = n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row in encode_slice(doc_ids, held, a_data.value, b_data.value, with_groups):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())] + to_batch(
                    {c.name: pa.array([row[c.name]], c.type) for c in target}, target).columns,
                    names=["n", *target.names])

        for batch in batches:
            for d, t in zip(batch.column("doc_id"), batch.column("text")):
                text = t.as_py()
                doc_ids.append(d.as_py())
                held.append(text)
                size += len(text or "")
                if size >= RUN_BYTES or len(held) >= RUN_ROWS:
                    yield from flush()
                    doc_ids, held, size, n = [], [], 0, n + 1
        if held:
            yield from flush()

    made = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, RUN_SCHEMA.replace("run long", "n long"))
    return shared_table(made.select((F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("n")).alias("run"),
                                    *target.names), "alignment-runs")


def count_pairs(runs: DataFrame, n_runs: int) -> DataFrame:
    """``part, keys``: one run of (pair, count) over the whole corpus for each part.

    Each level merges groups of some ``FAN`` runs of a part, so no task reads more,
    however common a B id is.
    """
    level = runs.where("part >= 0").select("part", F.col("run"), "keys")
    while n_runs > 1:
        n_runs = -(-n_runs // FAN)

        def merge(table: pa.Table) -> pa.Table:
            blob = merge_run(table.column("keys").to_pylist())
            return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "run": table.column("run")[:1].cast(pa.int64()),
                             "keys": pa.array([blob], pa.binary())})

        level = (level.select("part", F.pmod(F.xxhash64("run"), F.lit(n_runs)).alias("run"), "keys")
                 .groupBy("part", "run").applyInArrow(merge, "part int, run long, keys binary"))
    return level.select("part", "keys")


def highest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair's count is the highest of its B id; pairs are in side-major order."""
    b = keys >> A_BITS
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1])[:len(b)])
    if not len(first):
        return np.zeros(0, bool)
    return counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(b))))


def sums_back(runs: DataFrame, totals: DataFrame, n_runs: int) -> DataFrame:
    """``run, place, n_best, count_sum``: what each part gives to each document."""
    n_groups = max(1, -(-n_runs // FAN))
    some = F.pmod(F.xxhash64("run"), F.lit(n_groups)).cast("int")
    left = runs.where("part >= 0").select("part", some.alias("some"), "run", "keys", "places")
    right = totals.select("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("some"),
                          F.col("keys").alias("totals"))
    _, target = arrow_schema("run long, place long, n_best long, count_sum long")

    def send(mine: pa.Table, totals: pa.Table) -> pa.Table:
        batches = []
        for blob in totals.column("totals").to_pylist():
            all_keys, all_counts = whole(blob, 2)
            best = highest(all_keys, all_counts)
            for run, keys, places in zip(*(mine.column(c) for c in ("run", "keys", "places"))):
                at = np.searchsorted(all_keys, whole(keys.as_py(), 2)[0])
                pair, place, times = whole(places.as_py(), 3)
                order = np.argsort(place, kind="stable")
                place, pair, times = place[order], at[pair[order]], times[order]
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                batches.append(to_batch({
                    "run": pa.array([run.as_py()] * len(first), pa.int64()), "place": place[first],
                    "n_best": np.add.reduceat(times * best[pair], first),
                    "count_sum": np.add.reduceat(times * all_counts[pair], first)}, target))
        return pa.Table.from_batches(batches, target)

    return (left.groupBy("part", "some").cogroup(right.groupBy("part", "some"))
            .applyInArrow(send, "run long, place long, n_best long, count_sum long"))


def align_tokenizers(docs: DataFrame, a_path: str = BYTE_VOCABULARY, b_path: str = PIECE_VOCABULARY,
                     with_groups: bool = True) -> DataFrame:
    """Token alignment of every row of ``docs`` (doc_id, text): one row per row.

    A encodes blank + text, B the text (it adds the blank itself); special
    tokens in a text are plain text. ``n_a``, ``n_b``: tokens; ``n_groups``:
    stretches between bytes where tokens of both end; ``n_links``: pairs of
    tokens that share a byte; a pair of ids counts its links over all rows, and
    ``count_sum`` adds the counts of the row's links, ``n_best`` the links whose
    count is the highest of their B id (ties too). ``groups`` lists the groups
    (``with_groups=False`` leaves it out), ``groups_sha256`` is its digest.
    Null and empty texts, and those that one of the vocabularies does not spell
    byte for byte, have zeros and ''. Repeated rows each count and each give a
    row, whatever their ids; other columns are ignored; an empty table gives an
    empty result. The corpus is encoded once; a task holds one slice of texts,
    a frame of each merged run, or one part's counts (distinct pairs / ``PARTS``).
    """
    runs = write_runs(docs, a_path, b_path, with_groups)
    n_runs = runs.where("part = -1").count()
    counted = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256") + (("groups",) if with_groups else ())
    zipped = F.arrays_zip("doc_ids", *counted)
    own = (runs.where("part = -1").select("run", F.posexplode(zipped))
           .select("run", F.col("pos").cast("long").alias("place"),
                   F.col("col.doc_ids").alias("doc_id"), *[F.col(f"col.{c}").alias(c) for c in counted],
                   F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")))
    if n_runs == 0:
        both = own
    else:
        both = own.unionByName(sums_back(runs, count_pairs(runs, n_runs), n_runs), allowMissingColumns=True)
    return (both.groupBy("run", "place")
            .agg(F.max("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in counted],
                 F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *counted[4:]))
