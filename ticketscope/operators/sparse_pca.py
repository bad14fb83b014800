"""Principal components of sparse vectors without centring them.

With row mean m the covariance is C = (X'X - n m m') / (n - 1). A block of
vectors Q is multiplied by C as X'(XQ) minus the rank-one part, so rows stay
sparse: a pass sends each term's sums of one block (terms x block doubles,
combined map-side) to the driver. Subspace iteration from a random block, with a
Rayleigh-Ritz step at the end, gives the leading components.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


#: Vectors of the block beyond the wanted components, for faster convergence.
EXTRA = 10
#: Largest terms x block product (doubles) that a pass may send to the driver.
MAX_BLOCK = 4_000_000
#: Rows multiplied at a time in a task.
ROWS = 256


def sparse_rows(long: DataFrame, *, id_col: str = "doc_id", index_col: str = "index", value_col: str = "tfidf") -> DataFrame:
    """``(id, idx, val)`` from long-form weights: one row per document with a weight."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(index_col).cast("int").alias("i"), F.col(value_col).cast("double").alias("v"))))
    return (long.groupBy(F.col(id_col).alias("id")).agg(pairs.alias("p"))
            .select("id", F.col("p.i").alias("idx"), F.col("p.v").alias("val")))


def csr(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch as (row of each entry, its index, its value)."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        idx, val = part.column("idx"), part.column("val")
        sizes = np.diff(idx.offsets.to_numpy())
        yield (np.repeat(np.arange(part.num_rows), sizes), idx.flatten().to_numpy().astype(np.int64), val.flatten().to_numpy())


def filled(row: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a slice and its ``n`` rows over them with their zeros, for dense products."""
    seen = np.zeros(size, bool)
    seen[idx] = True
    own = np.flatnonzero(seen)
    at = (np.cumsum(seen) - 1)[idx]
    return own, np.bincount(row * len(own) + at, weights=val, minlength=n * len(own)).reshape(n, len(own))


def times_gram(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """X'(X block) in one pass over ``rows``."""
    size, width = block.shape
    shared = rows.sparkSession.sparkContext.broadcast(block)
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        total, seen = np.zeros((size, width)), np.zeros(size, bool)
        for batch in batches:
            for row, idx, val in csr(batch):
                if not len(row):
                    continue
                own, x = filled(row, idx, val, int(row[-1]) + 1, size)
                total[own] += x.T @ (x @ q[own])
                seen[own] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(total[at, j]) for j in range(width)]],
                                         names=["i", *names])

    parts = rows.select("idx", "val").mapInArrow(run, "i int, " + ", ".join(f"{n} double" for n in names))
    got = parts.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((size, width))
    out[got.column("i").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], 1)
    return out


@dataclass(frozen=True)
class SparsePca:
    """Components (terms x k), row mean, variance along each component, total variance, rows."""

    components: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    total_variance: float
    n: int

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per term: its mean and its weights; and one for the variances (term -1)."""
        rows = [(-1, float(self.total_variance), self.variance.tolist(), self.n)]
        rows += [(i, float(m), w.tolist(), 0) for i, (m, w) in enumerate(zip(self.mean, self.components))]
        spark.createDataFrame(rows, "term int, mean double, weights array<double>, n long").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SparsePca":
        rows = spark.read.parquet(path).orderBy("term").collect()  # one row per term, the vocabulary's bound
        return SparsePca(np.array([r.weights for r in rows[1:]]), np.array([r["mean"] for r in rows[1:]]),
                         np.array(rows[0].weights), rows[0]["mean"], rows[0].n)


def fit_sparse_pca(rows: DataFrame, *, size: int, k: int = 100, tol: float = 1e-4, max_passes: int = 30,
                   seed: int = 42, n: int | None = None) -> SparsePca:
    """Leading ``k`` components of the rows (``idx``, ``val``) of ``size`` terms.

    ``n`` counts rows that are all zero too (default: the rows given). Passes end
    when the variance that the components hold grows by less than ``tol`` of it.
    """
    k = min(k, size)
    width = min(size, k + EXTRA)
    if size * width > MAX_BLOCK:
        raise ValueError(f"{size} terms x {width} vectors exceed {MAX_BLOCK} doubles")
    sums = (rows.select(F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy(F.col("e.idx").alias("i"))
            .agg(F.sum("e.val").alias("s"), F.sum(F.col("e.val") * F.col("e.val")).alias("s2")).toArrow())
    n = n if n is not None else rows.count()
    mean, square = np.zeros(size), np.zeros(size)
    mean[sums.column("i").to_numpy()] = sums.column("s").to_numpy() / max(n, 1)
    square[sums.column("i").to_numpy()] = sums.column("s2").to_numpy()
    if n < 2:
        return SparsePca(np.eye(size, k), mean, np.zeros(k), 0.0, n)

    def times_cov(q: np.ndarray) -> np.ndarray:
        return (times_gram(rows, q) - n * np.outer(mean, mean @ q)) / (n - 1)

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    before = None
    for _ in range(max_passes):
        z = times_cov(q)
        values, vectors = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        best, kept = q @ vectors[:, :k], values[:k]
        if before is not None and kept.sum() - before <= tol * kept.sum():
            break
        before = kept.sum()
        q = np.linalg.qr(z)[0]
    sign = np.sign(best[np.abs(best).argmax(0), np.arange(k)])  # the largest weight of a component is positive
    return SparsePca(best * np.where(sign == 0, 1, sign), mean, np.maximum(kept, 0.0),
                     float((square.sum() - n * (mean @ mean)) / (n - 1)), n)


def apply_sparse_pca(rows: DataFrame, model: SparsePca, *, out: str = "pca") -> DataFrame:
    """``id`` and the centred row's coordinates: components'x minus components'm, a map."""
    shared = rows.sparkSession.sparkContext.broadcast((model.components, model.mean @ model.components))
    schema = StructType([rows.schema["id"], StructField(out, ArrayType(DoubleType()))])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        components, shift = shared.value
        for batch in batches:
            at = 0
            for row, idx, val in csr(batch):
                ids = batch.column("id").slice(at, ROWS)
                at += ROWS
                own, x = filled(row, idx, val, len(ids), len(components))
                z = x @ components[own] - shift
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(z), target.field(out).type)], schema=target)

    return rows.select("id", "idx", "val").mapInArrow(run, schema)
