"""n-grams of token arrays, counted a slice of documents at a time.

A task numbers the words of a slice and counts n-grams as numbers; only the sums
of a slice (one row per different n-gram) are shuffled. An n-gram is at most as
frequent as each of its words, so once the words are counted, n-grams with a word
that is too rare for the vocabulary are left out before they are counted.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ticketscope.session import materialize

#: Bytes of text that a task counts at a time (a single document may have more).
SLICE_BYTES = 1 << 22
#: Most words that are sent to the tasks as frequent enough; beyond them nothing is left out.
MOST_KNOWN = 500_000
#: Product of number ranges up to which n-grams of a slice are numbered without renumbering.
NUMBERS = 1 << 62


def by_document(df: DataFrame, *, id_col: str, text_col: str, tokens: Column) -> DataFrame:
    """(doc_id, toks): the ``tokens`` (of column ``t``, without blanks in them) of each
    text, joined by blanks. The rows of an id stand next to each other in one partition.

    Texts are shuffled, not their tokens, and tokenised once: the result is kept.
    """
    t = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).repartition("doc_id").sortWithinPartitions("doc_id")
    return materialize(t.select("doc_id", F.coalesce(F.array_join(tokens, " "), F.lit("")).alias("toks")))


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    return pc.binary_length(batch.column("toks")).to_numpy()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE_BYTES``."""
    ends = np.cumsum(_bytes(batch), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _starts(ids: pa.Array) -> np.ndarray:
    """Rows whose id differs from the row before (nulls are equal)."""
    if not len(ids):
        return np.zeros(0, np.int64)
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    same = pc.or_(both, pc.fill_null(pc.equal(a, b), False))
    return np.flatnonzero(np.append(True, ~np.asarray(same, bool)))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of whole documents with about ``SLICE_BYTES`` of text."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for part in _parts(batch):
            held.append(part)
            n += int(_bytes(part).sum())
            if n < SLICE_BYTES:
                continue
            t = pa.concat_batches(held)
            last = int(_starts(t.column("doc_id"))[-1])  # its rows may go on
            if last:
                yield t.slice(0, last)
            held = [t.slice(last)]
            n = int(_bytes(held[0]).sum())
    if held:
        yield pa.concat_batches(held)


class Slice:
    """Words of a slice as numbers, with the line (row) and the document of each."""

    def __init__(self, batch: pa.RecordBatch):
        toks = pc.split_pattern(batch.column("toks"), " ")
        words = toks.flatten().dictionary_encode()
        self.names = words.dictionary
        code = words.indices.to_numpy().astype(np.int64)
        # a text without a token splits into one empty word
        self.code = np.where(np.asarray(pc.equal(self.names, ""), bool)[code], -1, code) if len(code) else code
        starts = _starts(batch.column("doc_id"))
        self.ids = batch.column("doc_id").take(pa.array(starts))
        sizes = np.diff(toks.offsets.to_numpy())
        self.line = np.repeat(np.arange(batch.num_rows), sizes)
        self.doc = np.repeat(np.repeat(np.arange(len(starts)), np.diff(starts, append=batch.num_rows)), sizes)

    def grams(self, n: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams of words with a ``number`` (per token, -1: none) start, and
        the numbers of their words (grams x n)."""
        last = len(number) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros((0, n), np.int64)
        ok = self.line[:last] == self.line[n - 1:]
        for k in range(n):
            ok &= number[k:last + k] >= 0
        at = np.flatnonzero(ok)
        return at, np.stack([number[at + k] for k in range(n)], 1)


def _numbered(words: np.ndarray, size: int) -> np.ndarray:
    """One number per row of ``words`` (numbers below ``size``), equal for equal rows."""
    key, top = words[:, 0], size
    for k in range(1, words.shape[1]):
        if top > NUMBERS // max(size, 1):
            key = np.unique(key, return_inverse=True)[1]
            top = len(key) + 1
        key, top = key * size + words[:, k], top * size
    return key


def count_grams(docs: DataFrame, lo: int, hi: int, known: list[str] | None = None) -> DataFrame:
    """(term, df, total) of the n-grams of ``by_document`` rows, of ``known`` words
    only if these are given; n-grams stay within a row."""
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(pa.array(known, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = Slice(batch)
            number = s.code
            if shared is not None and len(s.names):
                number = np.where(np.asarray(pc.is_in(s.names, shared.value), bool)[number], number, -1)
            for n in range(lo, hi + 1):
                at, words = s.grams(n, number)
                if not len(at):
                    continue
                key, first, of = np.unique(_numbered(words, len(s.names)), return_index=True, return_inverse=True)
                docs_of = np.unique(of * len(s.ids) + s.doc[at]) // len(s.ids)
                parts = [s.names.take(pa.array(words[first, k])) for k in range(n)]
                term = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
                yield pa.RecordBatch.from_arrays([term, pa.array(np.bincount(docs_of, minlength=len(key))),
                                                  pa.array(np.bincount(of, minlength=len(key)))], names=["term", "df", "total"])

    found = docs.select("doc_id", "toks").mapInArrow(run, "term string, df long, total long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


class Lookup:
    """n-grams of a vocabulary by the numbers of their words."""

    def __init__(self, terms: list[str], index: list[int]):
        split = [t.split(" ") for t in terms]
        names = sorted({w for ws in split for w in ws})
        of = {w: i for i, w in enumerate(names)}
        self.names, self.size, self.by_n = pa.array(names, pa.string()), max(len(names), 1), {}
        for n in sorted({len(ws) for ws in split}):
            rows = [([of[w] for w in ws], i) for ws, i in zip(split, index) if len(ws) == n]
            words = np.array([r for r, _ in rows], np.int64)
            if self.size ** n >= NUMBERS:
                raise ValueError(f"{self.size} words are too many for {n}-grams")
            key = _numbered(words, self.size)
            order = np.argsort(key)
            self.by_n[n] = key[order], np.array([i for _, i in rows], np.int64)[order]

    def found(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Documents and indices of all places of the vocabulary's n-grams."""
        if not len(s.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = pc.fill_null(pc.index_in(s.names, self.names), -1).to_numpy().astype(np.int64)
        number, doc, index = np.where(s.code < 0, -1, own[s.code]), [], []
        for n, (keys, of) in self.by_n.items():
            at, words = s.grams(n, number)
            if not len(at):
                continue
            key = _numbered(words, self.size)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            doc.append(s.doc[at[hit]])
            index.append(of[place[hit]])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(doc or none), np.concatenate(index or none)


def term_rows(docs: DataFrame, terms: list[str], index: list[int], weight: list[float] | None = None) -> DataFrame:
    """(doc_id, idx, tf, val) of the documents with a term: indices in order, counts,
    and counts times ``weight`` (by index; default 1) over the row's length."""
    size = max(index, default=-1) + 1
    w = np.ones(size)
    if weight is not None:
        w[np.array(index, np.int64)] = weight
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(terms, index), w))
    schema = StructType([docs.schema["doc_id"], StructField("idx", ArrayType(IntegerType())), StructField("tf", ArrayType(LongType())),
                         StructField("val", ArrayType(DoubleType()))])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, weights = shared.value
        for batch in slices(batches):
            s = Slice(batch)
            doc, index = lookup.found(s)
            if not len(doc):
                continue
            pair, tf = np.unique(doc * len(weights) + index, return_counts=True)
            doc, index = pair // len(weights), pair % len(weights)
            val = tf * weights[index]
            head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            norm = np.sqrt(np.add.reduceat(val * val, head))
            val = val / np.repeat(norm, np.diff(head, append=len(doc)))
            edges = pa.array(np.append(head, len(doc)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (index.astype(np.int32), tf.astype(np.int64), val)]
            ids = s.ids.take(pa.array(doc[head]))
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([ids, *lists], target)], schema=target)

    return docs.select("doc_id", "toks").mapInArrow(run, schema)
