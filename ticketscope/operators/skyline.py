"""Rows that no other row dominates (all objectives maximised), by cells of the
objective space.

Quantiles cut each objective into a few ranges; their product are the cells. A
cell is dropped whole when another cell lies above it in every objective, and a
vector is compared only with vectors of cells that reach at least as high
everywhere, so the comparison is an equi-join on cells, not a join of all pairs.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

from ticketscope.session import materialize

#: Most cells; cell tables and one strong vector a cell are small enough for the driver.
CELLS = 4096
#: Most ranges of one objective.
RANGES = 16
#: Parts that a cell's vectors and a vector's rows are split into in the joins.
PARTS = 4
#: Types that a double holds exactly.
EXACT = (DoubleType, FloatType, ByteType, ShortType, IntegerType)


def _dominates(a: list[Column], b: list[Column]) -> Column:
    return reduce(Column.__and__, [x >= y for x, y in zip(a, b)]) & reduce(Column.__or__, [x > y for x, y in zip(a, b)])


def dominated(v: np.ndarray, by: np.ndarray, strict: bool = False, chunk: int = 256) -> np.ndarray:
    """Which rows of ``v`` a row of ``by`` dominates; ``strict``: in every objective."""
    out = np.zeros(len(v), bool)
    if len(by):
        for at in range(0, len(v), chunk):
            x = v[at:at + chunk, None, :]
            above = by[None] > x
            out[at:at + chunk] = (above.all(2) if strict else (by[None] >= x).all(2) & above.any(2)).any(1)
    return out


def local_skyline(v: np.ndarray, strict: bool = False, chunk: int = 256) -> np.ndarray:
    """Places of the rows of ``v`` that no other row of it dominates, strongest first."""
    with np.errstate(invalid="ignore"):
        order = np.argsort(-v.sum(1), kind="stable")
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), chunk):
        part = order[at:at + chunk]
        part = part[~dominated(v[part], v[kept], strict)]
        part = part[~dominated(v[part], v[part], strict)]
        kept = np.append(kept, part)
    return kept


def cell_targets(cells: np.ndarray, whole: bool) -> list[tuple[int, list[int]]]:
    """For each cell (a row of range numbers) that is kept, the places of the kept
    cells whose vectors it may dominate. ``whole``: the ranges cover every
    objective, so a cell above another in all of them dominates it whole."""
    live = np.flatnonzero(~dominated(cells, cells, strict=True)) if whole else np.arange(len(cells))
    return [(int(b), [int(a) for a in live[(cells[live] <= cells[b]).all(1)]]) for b in live]


def skyline(df: DataFrame, objectives: list[str], *, id_col: str) -> DataFrame:
    """Rows of ``df`` that no other row dominates: at least as good in every
    objective and better in one.

    Equal rows do not dominate each other, so all of them stay; a row with a null
    objective neither dominates nor is dominated and stays. Rows are first
    reduced to distinct vectors. The strongest vector of each cell thins them out
    in one pass (the best of them against each batch, memory bounded by the
    batch), and the survivors are settled by a join on cells.
    """
    spark = df.sparkSession
    names = [f"v{i}" for i in range(len(objectives))]
    known = reduce(Column.__and__, [F.col(o).isNotNull() for o in objectives])
    vectors = materialize(df.where(known).select(*[F.col(o).alias(n) for o, n in zip(objectives, names)]).distinct())
    strict = not all(isinstance(vectors.schema[n].dataType, EXACT) for n in names)
    axes = names[:int(np.log2(CELLS))]
    ranges = min(RANGES, max(2, int(CELLS ** (1 / len(axes)) + 1e-9)))
    cuts = vectors.select(*[F.col(n).cast("double") for n in axes]).approxQuantile(
        axes, [(i + 1) / ranges for i in range(ranges - 1)], 0.001)
    numbers = [sum(((F.col(n).cast("double") > c).cast("int") for c in sorted(set(cut))), F.lit(0))
               for n, cut in zip(axes, cuts or [[]] * len(axes))]
    cell = sum((k * ranges ** i for i, k in enumerate(numbers)), F.lit(0)).cast("int")
    best = F.max_by(F.array(*[F.col(n).cast("double") for n in names]), sum(F.col(n).cast("double") for n in names))
    found = vectors.groupBy(cell.alias("cell")).agg(best.alias("best")).collect()  # at most CELLS rows
    if not found:
        return df
    ids = np.array([r.cell for r in found])
    targets = cell_targets(ids[:, None] // ranges ** np.arange(len(axes)) % ranges, len(axes) == len(names))
    strong = np.array([r.best for r in found], float)
    strong = strong[local_skyline(strong)]
    live = np.zeros(ranges ** len(axes), bool)
    live[ids[[b for b, _ in targets]]] = True

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(live[batch.column("cell").to_numpy()]))
            v = np.column_stack([np.asarray(batch.column(n).cast(pa.float64(), safe=False)) for n in names]) \
                if batch.num_rows else np.zeros((0, len(names)))
            left = np.flatnonzero(~dominated(v, strong, strict))
            yield batch.take(pa.array(left[local_skyline(v[left], strict)]))

    celled = vectors.withColumn("cell", cell)
    kept = materialize(celled.mapInArrow(thin, celled.schema))
    table = spark.createDataFrame([(int(ids[b]), [int(ids[a]) for a in to]) for b, to in targets], "cell int, target array<int>")
    # at most CELLS rows: a fixed bound, safe to broadcast
    above = kept.join(F.broadcast(table), "cell").select(
        F.explode("target").alias("target"), *[F.col(n).alias(f"o{i}") for i, n in enumerate(names)])
    above = above.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("of"))
    mine = kept.withColumn("part", F.pmod(F.xxhash64(*names), F.lit(PARTS)).cast("int"))
    front = mine.join(above, (F.col("cell") == F.col("target")) & (F.col("part") == F.col("of"))
                      & _dominates([F.col(f"o{i}") for i in range(len(names))], [F.col(n) for n in names]), "left_anti")
    front = front.select(*[F.col(n).alias(f"front_{n}") for n in names],
                         F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("front_part"))
    same = reduce(Column.__and__, [df[o] == front[f"front_{n}"] for o, n in zip(objectives, names)])
    part = F.pmod(F.xxhash64(df[id_col]), F.lit(PARTS)).cast("int")
    return df.where(known).join(front, (part == front["front_part"]) & same, "left_semi").unionByName(df.where(~known))
