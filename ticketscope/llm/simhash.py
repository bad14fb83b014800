"""SimHash near-duplicates through an inverted index over fingerprint bytes.

Two 64-bit fingerprints that differ in at most k bits share at least 8 - k of
their 8 bytes, byte by byte. The index lists fingerprints under positional
bytes; pairs that meet in a list have their shared positional bytes counted,
pairs below 8 - k go, and the rest are verified by their differing bits.

A list under one byte holds 1/256 of all fingerprints, so pairs from such lists
grow with the square of the corpus. The index therefore joins bytes: the 8
positions are dealt into k + 2 blocks, of which two agree in full, and a term is
the bytes of two blocks (four bytes for k = 2).
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ticketscope.llm.common import cut, fresh, map_arrow, texts
from ticketscope.llm.graph import components

SEED = 42
#: Lists up to this length are compared pair by pair; longer ones through variants.
PAIR_LIST = 64
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: A-Z lowered, words parted by ASCII white space,
    shingles joined by one blank; a bit is set if over half the shingles' XXH64
    values have it. Fewer words than a shingle: all of them; none: 0."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:min(at + CHUNK, n) + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
        h = np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long) of every row; null texts count as empty."""
    def run(batch: pa.RecordBatch):
        fp = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64)
        yield {"doc_id": batch.column("doc_id"), "fp": fp.view(np.int64)}

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run,
                     "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def index_masks(max_bits: int) -> list[int]:
    """Bit masks of the index terms: two of ``max_bits + 2`` blocks of byte positions."""
    blocks = [sum(0xFF << 8 * int(b) for b in part) for part in np.array_split(np.arange(8), max_bits + 2)]
    return [a | b for a, b in combinations(blocks, 2)]


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the 8 positional bytes two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(_signed(0xFF << 8 * i)) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """``u, v``: links that join exactly the distinct fingerprints ``fp`` that
    are within ``max_bits`` (1 or 2) bits, directly or along other such links.

    Short lists: every pair is counted and verified. A list above ``PAIR_LIST``
    members would give pairs with the square of its length; there each member
    is put under the values that one flipped free bit (or none) gives. Members
    under the same value differ in two bits at most, and any two that differ in
    two or fewer meet under one, so each links to the smallest there (for one
    bit: to the value itself, if it is a member). 33 rows a member, no pairs.
    """
    masks = index_masks(max_bits)
    posts = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("term"), F.col("fp").bitwiseAND(_signed(m)).alias("bytes"))
        for i, m in enumerate(masks)])).alias("t")).select("fp", "t.*")
    sizes = posts.groupBy("term", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    lists = cut(posts.join(sizes, ["term", "bytes"]))

    def near(a: Column, b: Column) -> Column:
        return (shared_bytes(a, b) >= 8 - max_bits) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)

    short = lists.where(F.col("n") <= PAIR_LIST).groupBy("term", "bytes").agg(F.collect_list("fp").alias("m"))
    pairs = short.select(F.inline(F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: (y < x) & near(x, y)), lambda y: F.struct(x.alias("u"), y.alias("v"))))))).distinct()

    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[
        F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in masks]), F.col("term") + 1)
    under = (lists.where(F.col("n") > PAIR_LIST)
             .select("term", "bytes", "fp", F.explode(flips).alias("flip"))
             .select("term", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")))
    if max_bits == 1:
        far = under.where("fp <> value").select(F.col("fp").alias("u"), F.col("value").alias("v"))
        long = far.join(fps.select(F.col("fp").alias("v")), "v", "left_semi").select("u", "v")
    else:  # at most 33 members (a value and its one-bit neighbours) meet under a value
        long = (under.groupBy("term", "value").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1)
                .select(F.explode("m").alias("u"), F.array_min("m").alias("v")).where("u <> v"))
    return pairs.unionByName(long)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links of at most ``max_bits``
    (0, 1 or 2) differing bits reach, the row's own included. Copies share a
    fingerprint and are one node of the index. Empty and null texts have
    fingerprint 0; a null doc_id is no representative (null if a component has
    no other); rows that share a doc_id each get a row; extra columns are
    ignored. Texts are read once; all else works on 16 bytes a document.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits: 0, 1 or 2")
    rows = cut(fingerprints(docs, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    if max_bits:
        roots = components(links(fps.select("fp"), max_bits)).withColumnRenamed("node", "fp")
        known = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        ids = known.groupBy("root").agg(F.min("first").alias("component_id"))
        fps = known.join(ids, "root").select("fp", "component_id", "root")
    else:
        fps = fps.select("fp", F.col("first").alias("component_id"), F.col("fp").alias("root"))
    return rows.join(fps, "fp").select("doc_id", "fp", "component_id", "root")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id``."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each component: the one with its smallest
    doc_id. Rows that repeat a doc_id and text stay once; rows without a doc_id
    stay (each text once) if no document of their component has one."""
    found = near_duplicates(docs, shingle, max_bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept_id = fresh(docs, "kept_id")
    kept = cut(found.groupBy(F.col("doc_id").alias(kept_id)).agg(F.count("*").alias(fresh(docs, "n_rows"))))
    one = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
    return one if kept.where(F.col(kept.columns[1]) > 1).isEmpty() else one.dropDuplicates(["doc_id", "text"])
