"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a seed (a run of ``min_match`` words) are
joined; for each such pair the longest non-overlapping matches are marked again
and again by running Karp-Rabin, and the share of the item's words under tiles
is held against a threshold. Tiles may lie in any order, so reordered passages
are found as well.
"""

from __future__ import annotations

from collections import defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ticketscope.llm.common import arrow_schema, bitmap, fresh, in_bitmap, map_arrow, mix64, shared_table, to_batch
from ticketscope.llm.licenses import WORD_BYTES

#: Base of the rolling hash of word hashes (modulo 2**64).
BASE = 0x9E3779B97F4A7C15
#: Bits of the seed bitmap, as a power of two: 8 MB whatever the benchmark's size.
BITMAP_BITS = 26
#: Words of a text hashed at a time.
CHUNK = 1 << 18
#: Parts that a document's items are dealt over.
PARTS = 4
#: Rows of documents and items read at a time.
SLICE = 64


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of every word of the lower-cased text: runs of ASCII letters, digits and non-ASCII characters."""
    words = (text or "").lower().encode().translate(WORD_BYTES).split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + h[k:k + n]
    return mix64(out)


def _free_windows(x: list[int], used: list[bool], size: int) -> dict[int, int]:
    """Start to rolling hash of every window of ``size`` unmarked words."""
    out, h, run, m = {}, 0, 0, (1 << 64) - 1
    top = pow(BASE, size, 1 << 64)
    for i, v in enumerate(x):
        if used[i]:
            h = run = 0
            continue
        h, run = (h * BASE + v) & m, run + 1
        if run > size:
            h = (h - x[i - size] * top) & m
        if run >= size:
            out[i - size + 1] = h
    return out


def tile(item: list[int], doc: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles ``(item start, document start, length)`` of running Karp-Rabin
    greedy string tiling: longest matches first, no word under two tiles."""
    used_i, used_d = [False] * len(item), [False] * len(doc)
    tiles: list[tuple[int, int, int]] = []
    size = max(min_match, min(len(item), len(doc), 64))
    while True:
        places = defaultdict(list)
        for d, h in _free_windows(doc, used_d, size).items():
            places[h].append(d)
        matches, longest = [], 0
        for i, h in _free_windows(item, used_i, size).items() if places else ():
            for d in places.get(h, ()):
                if i and d and item[i - 1] == doc[d - 1] and not used_i[i - 1] and not used_d[d - 1]:
                    continue  # part of a match that starts earlier
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                       and not used_i[i + n] and not used_d[d + n]):
                    n += 1
                if n >= size:  # else the hashes collide
                    matches.append((n, i, d))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        marked = False
        for n, i, d in sorted(matches, key=lambda x: (-x[0], x[1], x[2])):
            if not any(used_i[i:i + n]) and not any(used_d[d:d + n]):
                used_i[i:i + n] = used_d[d:d + n] = [True] * n
                tiles.append((i, d, n))
                marked = True
        if not marked:  # what an overlap has left is tried at this size before a smaller one
            if size == min_match:
                return sorted(tiles)
            size = max(min_match, size // 2)


ITEM = "item_key struct<item_id:long,text_hash:long>, words array<long>"
SEEDED = "doc_key struct<doc_id:long,text_hash:long>, seeds array<long>, starts array<int>, runs array<array<long>>"
FOUND = ("doc_id long, item_id long, n_item_words int, n_matched int, coverage double, n_tiles int, "
         "longest_tile int, first_word int")


def item_words(benchmark: DataFrame) -> DataFrame:
    """``item_key, words``: word hashes of every test item."""
    def run(batch: pa.RecordBatch):
        yield {"item_key": batch.column("item_key"), "words": [word_hashes(t).view(np.int64) for t in batch.column("text").to_pylist()]}

    return map_arrow(benchmark.selectExpr(
        "struct(cast(item_id as long) item_id, xxhash64(cast(text as string)) text_hash) item_key",
        "cast(text as string) text"), run, ITEM)


def item_seeds(items: DataFrame, min_match: int) -> DataFrame:
    """``item_key, seed, n``: the distinct seeds of every item and at how many
    places each stands; items shorter than a seed have none."""
    def run(batch: pa.RecordBatch):
        ids, seeds, counts = [], [], []
        for i, words in zip(batch.column("item_key").to_pylist(), batch.column("words")):
            w, n = np.unique(window_hashes(words.values.to_numpy().view(np.uint64), min_match), return_counts=True)
            ids.extend([i] * len(w))
            seeds.append(w.view(np.int64))
            counts.append(n)
        yield {"item_key": ids, "seed": np.concatenate([np.zeros(0, np.int64), *seeds]),
               "n": np.concatenate([np.zeros(0, np.int64), *counts])}

    return map_arrow(items, run, ITEM.split(", words")[0] + ", seed long, n int").distinct()


def rarest_seeds(seeds: DataFrame, found: DataFrame, min_match: int, min_coverage: float) -> DataFrame:
    """``item_key, seed``: as many of an item's seeds, least common in the
    documents first, as a covered item must meet at least one of.

    Tiles that cover c of an item's w words hold at least c * w / min_match of
    its seed places (a tile of L words holds L - min_match + 1, and there are at
    most c * w / min_match tiles). So of any set of places that leaves out fewer
    than that, one is met; the places left out are those of the most common
    seeds, and a phrase of every item and document pairs none of them.
    """
    often = found.groupBy("seed").agg(F.count("*").alias("docs"))
    by_rarity = Window.partitionBy("item_key").orderBy("docs", "seed")
    places = F.sum("n").over(Window.partitionBy("item_key"))
    need = F.greatest(F.lit(1), F.ceil((F.lit(min_coverage) * (places + min_match - 1) - 1e-9) / min_match))
    ranked = seeds.join(often, "seed", "left").na.fill(0, ["docs"]).select(
        "item_key", "seed", "docs", (places - need + 1).alias("quota"),
        (F.sum("n").over(by_rarity.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return ranked.where((F.col("before") < F.col("quota")) & (F.col("docs") > 0)).select("item_key", "seed")


def seeded(docs: DataFrame, words: np.ndarray, min_match: int) -> DataFrame:
    """Documents with a window that may be a seed, their candidate seeds, and the
    runs of words that those windows cover (every tile lies within a run)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batch: pa.RecordBatch):
        keys, seeds, starts, runs = [], [], [], []
        for d, th, t in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(),
                            batch.column("text").to_pylist()):
            h = word_hashes(t)
            spots, found = [], []
            for at in range(0, max(1, len(h) - min_match + 1), CHUNK):
                w = window_hashes(h[at:at + CHUNK + min_match - 1], min_match)
                hit = np.flatnonzero(in_bitmap(shared.value, w))
                spots.append(hit + at)
                found.append(w[hit])
            spot = np.concatenate(spots)
            if not len(spot):
                continue
            first = np.flatnonzero(np.diff(spot, prepend=-min_match - 1) > min_match)
            last = np.append(first[1:], len(spot)) - 1
            keys.append({"doc_id": d, "text_hash": th})
            seeds.append(np.unique(np.concatenate(found)).view(np.int64))
            starts.append(spot[first].astype(np.int32))
            runs.append([h[a:b + min_match].view(np.int64) for a, b in zip(spot[first], spot[last])])
        if keys:
            yield {"doc_key": keys, "seeds": seeds, "starts": starts, "runs": runs}

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text",
                                     "xxhash64(cast(text as string)) text_hash"), run, SEEDED)


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, min_coverage: float = 0.0) -> DataFrame:
    """Tiling of the (document, test item) pairs that share a seed; all pairs that
    reach ``min_coverage`` are among them.

    Texts are read once; a fixed-size bitmap of the items' seeds (8 MB for any
    benchmark) drops most documents in the scan, and the join on each item's
    rarest seeds settles the rest. Only word hashes of the covered runs are
    shuffled: a document's runs go once to each of the ``PARTS`` that its items
    are dealt over, and its items stream past them. Null and empty texts and
    items of fewer than ``min_match`` words share nothing.
    """
    items = shared_table(item_words(benchmark), "items")
    seeds = shared_table(item_seeds(items, min_match), "seeds")
    hits = shared_table(seeded(docs, bitmap(seeds, "seed", BITMAP_BITS), min_match), "seeded")
    found = hits.select("doc_key", F.explode("seeds").alias("seed")).join(seeds.select("seed").distinct(), "seed", "left_semi")
    pairs = shared_table(found.join(rarest_seeds(seeds, found, min_match, min_coverage), "seed")
                         .select("doc_key", "item_key").distinct(), "pairs")
    part = F.pmod(F.xxhash64("item_key"), F.lit(PARTS)).cast("int").alias("part")
    kind = [F.lit(None).cast(f).alias(n) for n, f in (("starts", "array<int>"), ("runs", "array<array<long>>"), ("copies", "long"))]
    work = pairs.join(items, "item_key").select("doc_key", part, F.lit(1).alias("kind"), *kind, "item_key.item_id", "words")
    texts = hits.groupBy("doc_key").agg(F.first("starts").alias("starts"), F.first("runs").alias("runs"), F.count("*").alias("copies"))
    texts = texts.join(pairs.select("doc_key", part).distinct(), "doc_key").select(
        "doc_key", "part", F.lit(0).alias("kind"), "starts", "runs", "copies", F.lit(None).cast("long").alias("item_id"),
        F.lit(None).cast("array<long>").alias("words"))
    _, target = arrow_schema(FOUND)
    names = [f.name for f in target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, place, doc_id, copies = [], [], None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = []
                for x in batch.slice(at, SLICE).to_pylist():
                    if x["kind"] == 0:  # a document, before its items
                        doc, place, doc_id, copies = [], [], x["doc_key"]["doc_id"], x["copies"]
                        for a, r in zip(x["starts"], x["runs"]):
                            doc += [*(v % (1 << 64) for v in r), -1 - len(doc)]  # a mark that no word equals
                            place += [*range(a, a + len(r)), -1]
                        continue
                    item = [v % (1 << 64) for v in x["words"]]
                    t = tile(item, doc, min_match)
                    n = sum(k for _, _, k in t)
                    out.extend([(doc_id, x["item_id"], len(item), n, n / len(item), len(t), max((k for _, _, k in t), default=0),
                                 min((place[d] for _, d, _ in t), default=None))] * copies)
                if out:
                    yield to_batch(dict(zip(names, map(list, zip(*out)))), target)

    order = ["doc_key", "part", "kind"]
    return (texts.unionByName(work).repartition("doc_key", "part").sortWithinPartitions(*order)
            .mapInArrow(run, FOUND))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, min_coverage: float = 0.8) -> DataFrame:
    """One row per (document, test item) whose tiles cover at least
    ``min_coverage`` of the item's words, wherever and in whatever order they
    stand. Repeated rows of a document or an item give repeated rows; null ids
    pass through; extra columns are ignored; no match, no row."""
    return overlaps(docs, benchmark, min_match, min_coverage).where(F.col("coverage") >= min_coverage)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5,
                      min_coverage: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    bad_id = fresh(docs, "bad_id")
    bad = contaminated(docs, benchmark, min_match, min_coverage).select(F.col("doc_id").alias(bad_id)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)), "left_anti")
