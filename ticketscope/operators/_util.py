"""Small helpers shared by the operators."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def as_of_col(df: DataFrame, as_of=None, ts: str = "ts") -> Column:
    """The reference time as a Column.

    ``None`` means ``max(ts)`` of ``df`` as a scalar subquery (computed once,
    inlined as a literal by the planner; no join, no driver round trip).
    Literals are cast to the timestamp flavour of ``df[ts]``.
    """
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        return df.select(F.max(ts)).scalar()
    kind = "timestamp_ntz" if isinstance(df.schema[ts].dataType, TimestampNTZType) else "timestamp"
    if isinstance(as_of, (_dt.datetime, _dt.date)):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(as_of)).cast(kind)


def hours(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def minutes(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def days(n) -> Column:
    return F.make_dt_interval(F.lit(n))


def safe_div(num, den) -> Column:
    """Guarded division: null when the denominator is 0 or null (ANSI-safe)."""
    return F.try_divide(num, den)


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def avg_if(cond: Column, value: Column) -> Column:
    return F.avg(F.when(cond, value))


def explode_fired(df: DataFrame, keep: list, cands: list[Column], name: str = "a") -> DataFrame:
    """One row per non-null struct among ``cands`` (one row per fired rule).

    ``explode`` + null filter rather than a higher-order ``filter``, so the
    candidates may reference scalar subqueries (``as_of``).
    """
    return df.select(*keep, F.explode(F.array(*cands)).alias(name)).where(F.col(name).isNotNull())


_EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (NTZ) timestamp, with no
    session-time-zone conversion (``unix_micros`` needs an LTZ cast)."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def from_epoch_seconds(c: Column) -> Column:
    """Inverse of ``epoch_micros`` at second resolution, as TIMESTAMP_NTZ."""
    return F.timestamp_add("SECOND", c, F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))
