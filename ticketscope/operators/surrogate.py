"""Local surrogates of a linear text model from masks over distinct words.

A perturbed text is a subset of the document's distinct words, so its TF-IDF norm
and class sums are products of the 0/1 mask matrix with the document's entries:
no token array is copied or scored per sample. A task holds one document
(samples x distinct words). Works on the pipelines of ``ml_train_pipeline`` with
a logistic regression.
"""

from __future__ import annotations

from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents whose tokens are unpacked together.
DOCUMENTS = 64
#: Words hashed at a time with all samples, so that their numbers stay in a core's cache.
WORDS = 64
#: Unknowns solved at a time with a factored matrix.
BLOCK = 48
#: Least ratio of Cholesky pivots up to which the normal equations are solved; below, ``lstsq``.
PIVOTS = 1e-5
#: Ratio below which their solution is improved once by its rest.
UNEVEN = 0.05


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                  0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


class _Hash:
    """Running 64-bit hashes (XXH64) as Spark's ``xxhash64`` chains its columns, changed in place; ``h`` is
    samples or words x samples, constants are numbers or one per word."""

    def __init__(self, h: np.ndarray):
        self.h, self.t = h, np.empty_like(h)

    def turn(self, bits: int) -> None:
        np.left_shift(self.h, np.uint64(bits), out=self.t)
        np.right_shift(self.h, np.uint64(64 - bits), out=self.h)
        np.bitwise_or(self.h, self.t, out=self.h)

    def step(self, k, bits: int, times, plus=None) -> None:
        np.bitwise_xor(self.h, k, out=self.h)
        self.turn(bits)
        np.multiply(self.h, times, out=self.h)
        if plus is not None:
            np.add(self.h, plus, out=self.h)

    def fold(self, bits: int) -> None:
        np.right_shift(self.h, np.uint64(bits), out=self.t)
        np.bitwise_xor(self.h, self.t, out=self.h)

    def end(self) -> None:
        self.fold(33)
        np.multiply(self.h, _P2, out=self.h)
        self.fold(29)
        np.multiply(self.h, _P3, out=self.h)
        self.fold(32)

    def number(self, k) -> None:
        """An int column's value(s)."""
        np.add(self.h, _P5 + np.uint64(4), out=self.h)
        self.step(np.asarray(k).astype(np.uint32).astype(np.uint64) * _P1, 23, _P2, _P3)
        self.end()

    def texts(self, raw: np.ndarray) -> None:
        """A string column's values of one length: bytes, words x length."""
        size = raw.shape[1]
        at = size // 32 * 32
        if at:
            lanes = [_Hash(self.h + x) for x in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
            whole = np.ascontiguousarray(raw[:, :at]).view("<u8")
            for j in range(at // 8):
                v = lanes[j % 4]
                np.add(v.h, (whole[:, j] * _P2)[:, None], out=v.h)
                v.turn(31)
                np.multiply(v.h, _P1, out=v.h)
            self.h[:] = sum(_turned(v.h, bits) for v, bits in zip(lanes, (1, 7, 12, 18)))
            for v in lanes:
                np.bitwise_xor(self.h, _turned(v.h * _P2, 31) * _P1, out=self.h)
                np.multiply(self.h, _P1, out=self.h)
                np.add(self.h, _P4, out=self.h)
        else:
            np.add(self.h, _P5, out=self.h)
        np.add(self.h, np.uint64(size), out=self.h)
        while at + 8 <= size:
            k = np.ascontiguousarray(raw[:, at:at + 8]).view("<u8")
            self.step(_turned(k * _P2, 31) * _P1, 27, _P1, _P4)
            at += 8
        if at + 4 <= size:
            self.step(np.ascontiguousarray(raw[:, at:at + 4]).view("<u4").astype(np.uint64) * _P1, 23, _P2, _P3)
            at += 4
        for j in range(at, size):
            self.step(raw[:, j:j + 1].astype(np.uint64) * _P5, 11, _P1)
        self.end()


def dropped(start: int, words: list[str | None], n_samples: int, seed: int) -> np.ndarray:
    """1 where a perturbation (columns, from 1) drops the word (rows), else 0: the lowest bit of
    ``xxhash64(doc, sample, word, seed)``, with ``start`` = ``xxhash64(doc)``. Equals Spark's."""
    with np.errstate(over="ignore"):
        samples = _Hash(np.full(n_samples, start, np.int64).view(np.uint64))
        samples.number(np.arange(1, n_samples + 1))
        out = np.empty((len(words), n_samples), np.uint8)
        raw = [None if w is None else w.encode() for w in words]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            by_size.setdefault(-1 if w is None else len(w), []).append(i)
        for size, rows in by_size.items():
            for at in range(0, len(rows), WORDS):
                own = rows[at:at + WORDS]
                h = _Hash(np.repeat(samples.h[None], len(own), 0))
                if size >= 0:  # a null word leaves the hash as it is
                    h.texts(np.frombuffer(b"".join(raw[i] for i in own), np.uint8).reshape(len(own), size))
                h.number(seed)
                out[own] = h.h & np.uint64(1)
    return out


def factored_solve(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of L L'x = b by blocks, so that a matrix is factored once for all right sides."""
    n = len(b)
    x = b.copy()
    for i in range(0, n, BLOCK):
        x[i:i + BLOCK] = np.linalg.solve(lower[i:i + BLOCK, i:i + BLOCK], x[i:i + BLOCK] - lower[i:i + BLOCK, :i] @ x[:i])
    for i in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        j = min(i + BLOCK, n)
        x[i:j] = np.linalg.solve(lower[i:j, i:j].T, x[i:j] - lower[j:, i:j].T @ x[j:])
    return x


def surrogate_weights(masks: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the words (columns of the 0/1 matrix ``masks``) in the weighted
    least-squares fit of ``y`` with an intercept; the shortest solution if words
    outnumber samples. Scores that no word changes give zeros."""
    if np.ptp(y) == 0:
        return np.zeros(masks.shape[1])
    dist = 1.0 - masks.mean(axis=1)
    w = np.sqrt(np.exp(-(dist ** 2) / 0.25 ** 2))
    a = np.empty((masks.shape[1] + 1, len(masks)))  # words and intercept x samples
    np.multiply(masks.T, w, out=a[:-1])
    a[-1] = w
    b = y * w
    wide = a.shape[0] > a.shape[1]
    gram = a.T @ a if wide else a @ a.T
    try:
        lower = np.linalg.cholesky(gram)
        pivots = np.diag(lower)
        even = pivots.min() / pivots.max()
    except np.linalg.LinAlgError:
        even = 0.0
    if even < PIVOTS:
        return np.linalg.lstsq(a.T, b, rcond=None)[0][:-1]

    def solve(rest: np.ndarray) -> np.ndarray:
        return a @ factored_solve(lower, rest) if wide else factored_solve(lower, a @ rest)

    coef = solve(b)
    if even < UNEVEN:
        coef = coef + solve(b - coef @ a)
    return coef[:-1]


def confidence(m, words: list[str], tf: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Highest class probability of each subset of the words (rows of ``masks``)."""
    if len(m.labels) == 1:
        return np.ones(len(masks))
    idx = np.array([m.index.get(w, -1) for w in words], np.int64)
    known = np.flatnonzero(idx >= 0)
    tf, idx, kept = tf[known], idx[known], masks[:, known]
    norm = np.sqrt(kept @ (tf * m.idf[idx]) ** 2)
    sums = kept @ (m.weights[:, idx] * tf).T
    logits = m.intercept + np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1.0)[:, None], 0.0)
    return 1.0 / np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)


def linear_surrogate(df: DataFrame, model, *, id_col: str, tokens_col: str, n_samples: int, top_k: int, seed: int) -> DataFrame:
    """(doc_id, word, weight) as ``explain.ex_local_surrogate`` describes, for a ``counterfactual.LinearText``."""
    spark = df.sparkSession
    m = spark.sparkContext.broadcast(model)
    # the work is in the hashes and fits, not in the bytes read: documents are dealt out to all cores
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("start"), F.col(tokens_col).alias("toks")) \
        .repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("doc_id", "toks"))

    def explain(start: int, counts: Counter) -> tuple[list[str], np.ndarray]:
        names = list(counts)
        masks = (1.0 - dropped(start, names, n_samples, seed)).T
        masks[0] = 1.0  # sample 1 keeps everything
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        weights = surrogate_weights(masks, confidence(m.value, names, tf, masks))
        order = np.argsort(-np.abs(weights), kind="stable")[:top_k]
        return [names[i] for i in order], weights[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                ids, words, weights = [], [], [np.zeros(0)]
                for doc_id, start, toks in zip(*(part.column(c).to_pylist() for c in range(3))):
                    if toks:
                        names, found = explain(start, Counter(toks))  # by first place
                        ids += [doc_id] * len(names)
                        words += names
                        weights.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string()),
                                                  pa.array(np.concatenate(weights), pa.float64())], names=["doc_id", "word", "weight"])

    return docs.mapInArrow(run, "doc_id long, word string, weight double")
