"""Query registry: each entry pairs a Spark query with its DuckDB oracle.

A query is a callable ``(spark, sf_dir) -> DataFrame`` built from the
library operators over the fixture views. Double columns are snapped to a
binary grid on both sides with the same formula (``round(x * 2^20) / 2^20``):
two engines that sum in a different order differ in the last bits, and a
decimal grid would turn those bits into different digits whenever the true
value is an exact decimal tie (averages over 2^k rows often are). On a
binary grid such ties need 2^21 rows, and the snapped value is exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ticketscope.plans.fixtures import with_views

SCALE = 1048576.0


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None          # DuckDB body, may reference fixture views
    views: list[str] = field(default_factory=list)
    dbl: tuple[str, ...] = ()       # double columns of the result

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(self.fn(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = with_views(self.views, self.sql)
        if not self.dbl:
            return body
        rep = ", ".join(f"round(CAST({c} AS DOUBLE) * {SCALE}) / {SCALE} AS {c}" for c in self.dbl)
        return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) q"


def round_doubles(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.col(f"`{f.name}`").cast("double")
            cols.append((F.round(c * F.lit(SCALE)) / F.lit(SCALE)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def all_queries() -> dict[str, Query]:
    from ticketscope.plans import (q_dashboard, q_monitor, q_audit, q_learning, q_text,
                                   q_drift, q_ensemble, q_versions, q_responses, q_ml,
                                   q_streaming, q_io, q_extra)
    out: dict[str, Query] = {}
    for mod in (q_monitor, q_dashboard, q_audit, q_learning, q_text, q_drift, q_ensemble,
                q_versions, q_responses, q_ml, q_streaming, q_io, q_extra):
        for q in mod.QUERIES:
            if q.name in out:
                raise ValueError(f"duplicate query {q.name}")
            out[q.name] = q
    return out
