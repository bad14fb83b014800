"""Helpers shared by the operators: table reads, lineage cuts, Arrow maps, bitmaps."""

from __future__ import annotations

import uuid
from typing import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ticketscope.session import checkpoint_dir

#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 256
#: A table of at most this many rows (and a few numbers a row) may be broadcast.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: a reliable checkpoint in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage of a wide result: a compressed table in the shared checkpoint folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def arrow_schema(schema: str) -> tuple[StructType, pa.Schema]:
    kind = _parse_datatype_string(schema)
    return kind, to_arrow_schema(kind)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str,
              rows: int = SLICE_ROWS) -> DataFrame:
    """``fn`` takes slices of at most ``rows`` rows and yields columns (name to
    list or array); tasks hold one Arrow batch and one slice at a time."""
    _, target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for cols in fn(batch.slice(at, rows)):
                    yield to_batch(cols, target)

    return df.mapInArrow(run, schema)


def to_batch(cols: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type, from_pandas=False)
         for f in target], schema=target)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def bitmap(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """Fixed-size bitmap (2**bits bits) of a long column's low bits.

    Its size does not depend on the data: at most 2**(bits - 6) words reach
    the driver. A set bit may stand for several keys, so a hit is a hint only.
    """
    spot = F.col(key).bitwiseAND((1 << bits) - 1)
    words = (keys.select(F.shiftright(spot, 6).cast("int").alias("word"),
                         F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("mask")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key (uint64) is set."""
    spot = keys & np.uint64(len(words) * 64 - 1)
    return (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) != 0


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))
