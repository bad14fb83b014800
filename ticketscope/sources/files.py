"""File sources: ticket CSV/JSON/Parquet, multi-source union, validation,
plain-text attachments."""

from __future__ import annotations

import os
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ticketscope.schemas import TICKETS

REQUIRED = ("customer_message", "category")


class SchemaError(ValueError):
    pass


def src_csv_tickets(spark: SparkSession, path: str, *, schema=TICKETS, fmt: str = "csv",
                    required=REQUIRED) -> DataFrame:
    """Read tickets (csv with header, json lines or parquet) with a declared schema.

    Missing required columns raise; rows with a null in a required column
    are dropped. For CSV the header is checked against the declared schema
    (a tiny read of the first line, not a scan).
    """
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        missing = [c for c in required if c not in header]
        if missing:
            raise SchemaError(f"Missing required columns: {missing}")
        declared = StructType([schema[c] if c in schema.fieldNames() else StructField(c, StringType())
                               for c in header])
        df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
              .schema(declared).csv(path))
    elif fmt == "json":
        df = spark.read.schema(schema).json(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r} (csv, json, parquet)")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(f"Missing required columns: {missing}")
    for f in schema.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.dropna(subset=list(required))


def src_union_sources(sources: list[tuple[str, DataFrame]], with_file: bool = False) -> DataFrame:
    """Concatenate sources with differing columns, tagged with ``data_source``.

    ``with_file`` adds ``file_location`` from the scan's hidden ``_metadata``.
    """
    out = None
    for name, df in sources:
        d = df.withColumn("data_source", F.lit(name))
        if with_file:
            d = d.withColumn("file_location", F.col("_metadata.file_path"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def src_union_status(union: DataFrame) -> DataFrame:
    """Per-source status table: row count per ``data_source``."""
    return union.groupBy("data_source").agg(F.count("*").alias("rows"),
                                            F.lit("loaded").alias("status"))


def src_validate_schema(df: DataFrame, required=REQUIRED) -> DataFrame:
    """One row (is_valid, message): missing columns, or a required column all null.

    One aggregate pass counts non-nulls of every required column.
    """
    missing = [c for c in required if c not in df.columns]
    spark = df.sparkSession
    if missing:
        return spark.createDataFrame([(False, f"Missing required columns: {', '.join(missing)}")],
                                     "is_valid boolean, message string")
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in required])
    empty = [F.when(F.col(c) == 0, F.lit(f"Column '{c}' is completely empty")) for c in required]
    msg = F.coalesce(*empty, F.lit("Format is valid"))
    return counts.select((msg == "Format is valid").alias("is_valid"), msg.alias("message"))


# Plain-text attachment extensions read as text.
TEXT_EXTENSIONS = [".txt", ".log", ".csv", ".json", ".xml", ".html"]


#: Names or bytes of contents that a task hands on at a time (a single file may have more).
LISTED, READ_BYTES = 10_000, 1 << 24


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """What Spark's readers list of a folder: no hidden names, and ``_`` only before a partition's name."""
    with os.scandir(folder) as found:
        for e in found:
            if not (e.name.startswith(".") or e.name.endswith("._COPYING_") or (e.name.startswith("_") and "=" not in e.name)):
                yield e


def _files(path: str) -> Iterator[str]:
    if not os.path.isdir(path):
        yield path
        return
    for e in _entries(path):
        yield from _files(e.path) if e.is_dir() else (e.path,)


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder's name on a file system that tasks can open, or None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _folder_contents(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, content) of a local folder's files with one of the extensions, like ``binaryFile`` with all
    subfolders. A task hands on the names in the folder, the others list what lies below and read it, so no
    list of files is ever whole in the driver or a task."""
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column(0).to_pylist():
                held: list[str] = []
                for e in _entries(top):
                    held.append(e.path)
                    if len(held) == LISTED:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["at"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["at"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        held: list[bytes] = []
        n = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], names=["path", "content"])

        for batch in batches:
            for at in batch.column(0).to_pylist():
                for path in _files(at):
                    if not path.lower().endswith(tuple(extensions)):
                        continue
                    with open(path, "rb") as f:
                        content = f.read()
                    if not content:  # binaryFile has no row of an empty file
                        continue
                    held.append(content)
                    paths.append(f"file:{path}")
                    n += len(content)
                    if n >= READ_BYTES or len(held) == LISTED:
                        yield out()
                        paths, held, n = [], [], 0
        if held:
            yield out()

    top = spark.createDataFrame([(folder,)], "at string").mapInArrow(names, "at string")
    return top.repartition(parts, "at").mapInArrow(contents, "path string, content binary")


def src_text_attachments(spark: SparkSession, path_glob: str, *, ticket_of: Column | None = None,
                         max_chars: int | None = None, max_docs: int | None = None) -> DataFrame:
    """Read plain-text attachments with ``binaryFile``; one row per ticket.

    UTF-8 when valid (confidence 1.0) else ISO-8859-1 (0.8), stripped. A report
    may cut texts to ``max_chars`` and take the first ``max_docs`` files (by
    path) per ticket; by default nothing is cut. Texts joined by a blank line, mean confidence.
    ``ticket_of`` maps the file path to a ticket id (default: parent folder).
    A folder (a path without glob characters) is read with all its subfolders:
    on a file system that tasks can open they are listed and read by tasks, and the driver
    holds no list of files; elsewhere, and for a glob, the driver holds the list.
    """
    folder = not any(c in path_glob for c in "*?[{")
    local = _local_folder(spark, path_glob) if folder else None
    if local is not None and os.path.isdir(local):
        raw = _folder_contents(spark, local, TEXT_EXTENSIONS)
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", folder).load(path_glob).select("path", "content")
    ext_ok = F.exists(F.array(*[F.lit(e) for e in TEXT_EXTENSIONS]),
                      lambda e: F.lower(F.col("path")).endswith(e))
    raw = raw.where(ext_ok)
    utf8 = F.is_valid_utf8(F.col("content"))
    text = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    conf = F.when(utf8, F.lit(1.0)).otherwise(F.lit(0.8))
    tid = ticket_of if ticket_of is not None else F.element_at(F.split("path", "/"), -2)
    stripped = F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    docs = raw.select(tid.alias("ticket_id"), "path",
                      (stripped if max_chars is None else F.substring(stripped, 1, max_chars)).alias("text"),
                      conf.alias("confidence"))
    docs = docs.where(F.length("text") > 0)
    if max_docs is not None:
        docs = docs.withColumn("_r", F.row_number().over(Window.partitionBy("ticket_id").orderBy("path")))
        docs = docs.where(F.col("_r") <= max_docs)
    g = docs.groupBy("ticket_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda s: s["text"]),
                     "\n\n").alias("extracted_text"),
        F.count("*").alias("processed_count"), F.avg("confidence").alias("confidence"))
    return g


def fn_base64(col: Column) -> Column:
    """Strip a ``data:...;base64,`` prefix and decode to binary."""
    s = F.when(col.startswith("data:"), F.substring_index(col, ",", -1)).otherwise(col)
    return F.unbase64(s)
