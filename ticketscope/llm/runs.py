"""Periodic runs of words by string synchronising sets.

A run is a maximal stretch of words with smallest period q and at least 2q
words. Periods below ``3 * BASE_SCALE`` come from comparing the text with its
own shifts. Above, dyadic scales t = 8, 16, ... take the periods in [3t, 6t):
the scale's synchronising set holds the positions whose t-gram, or the t-gram t
words on, has the least hash among the t + 1 grams from there on. Grams of
period t/3 or less are left out, so the set depends on 2t words only, misses no
t positions in a row outside highly periodic regions, and is sparse. Two of its
positions with equal 2t words, [3t, 6t) apart, propose their distance as a
period; the proposal is extended word by word in both directions, so a hash
clash costs time and no result.

A run without a synchronising position in its first repetition lies over two
meeting regions of one small period (``abab ab`` against ``a bab ab``); such
pairs of regions give their periods, an arithmetic progression, directly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from itertools import count
from typing import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketscope.llm.common import map_arrow, mix64, texts

#: The least scale; smaller periods than three times this are compared directly.
BASE_SCALE = 8
#: Words that an extension compares first; doubled until a difference is found.
STEP = 64


def small_periods(ids: np.ndarray, below: int) -> np.ndarray:
    """Stretches ``(start, end, period)`` of every period under ``below``, of two
    periods and ``BASE_SCALE`` words at least, found by comparing with shifts."""
    out = []
    for q in range(1, min(below, len(ids) // 2 + 1)):
        same = np.flatnonzero(ids[q:] == ids[:-q])
        if not len(same):
            continue
        breaks = np.flatnonzero(np.diff(same) != 1)
        first = same[np.concatenate(([0], breaks + 1))]
        last = same[np.concatenate((breaks, [len(same) - 1]))]
        long = last - first + 1 >= max(q, BASE_SCALE - q)
        out.append(np.stack((first[long], last[long] + 1 + q, np.full(long.sum(), q)), 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row (prefix and suffix minima of blocks)."""
    pad = np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)
    blocks = np.concatenate((values, pad)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def synchronising(grams: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """Positions of the scale's synchronising set; ``periodic`` marks left-out grams."""
    top = np.iinfo(np.uint64).max
    value = np.where(periodic, top, np.minimum(grams, top - np.uint64(1)))
    least = least_ahead(value, scale + 1)
    n = len(least)
    return np.flatnonzero((least != top) & ((value[:n] == least) | (value[scale:scale + n] == least)))


def proposals(at: np.ndarray, context: np.ndarray, scale: int) -> np.ndarray:
    """Pairs ``(position, distance)`` of equal context, [3, 6) scales apart.

    Equal contexts stand over a third of a scale apart, so at most 18 lie within
    six scales of one.
    """
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    out = []
    for lag in range(1, len(at)):
        gap = at[lag:] - at[:-lag]
        near = (context[lag:] == context[:-lag]) & (gap < 6 * scale)
        if not near.any():
            break
        take = np.flatnonzero(near & (gap >= 3 * scale))
        out.append(np.stack((at[take], gap[take]), 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def extend(ids: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The stretch around word ``i`` in which words equal those q words on: [start, end)."""
    n = len(ids) - q
    hi, step = i, STEP
    while hi < n:
        m = min(step, n - hi)
        off = ids[hi:hi + m] != ids[hi + q:hi + q + m]
        if off.any():
            hi += int(off.argmax())
            break
        hi, step = hi + m, 2 * step
    lo, step = i, STEP
    while lo > 0:
        m = min(step, lo)
        off = (ids[lo - m:lo] != ids[lo - m + q:lo + q])[::-1]
        if off.any():
            lo -= int(off.argmax())
            break
        lo, step = lo - m, 2 * step
    return lo, hi


def checked(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal stretches of the proposed periods, of two periods at least."""
    out, q_now, reach = [], -1, -1
    for q, i in sorted((int(q), int(i)) for i, q in pairs):
        if q == q_now and i < reach:
            continue  # inside the stretch just extended
        lo, hi = extend(ids, i, q)
        q_now, reach = q, max(hi, i + 1)
        if hi - lo >= q:
            out.append((lo, hi + q, q))
    return out


def shift_of(ids: np.ndarray, left: int, right: int, p: int) -> int | None:
    """Words from ``left`` to where the p words at ``right`` stand in its period; None if nowhere."""
    twice = ids[left:left + 2 * p - 1]
    window = ids[right:right + p]
    for o in np.flatnonzero(twice[:p] == window[0]):
        if np.array_equal(twice[o:o + p], window):
            return int(o)
    return None


def over_meeting_regions(ids: np.ndarray, runs: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """Runs whose first period lies in one region and whose second in the next of the same small period."""
    out = []
    by_period = defaultdict(list)
    for s, e, p in runs:
        if e - s >= 3 * BASE_SCALE and e - s >= 9 * p:
            by_period[p].append((s, e))
    for p, regions in by_period.items():
        regions.sort()
        for (l1, r1), (l2, r2) in zip(regions, regions[1:]):
            most = min(r1 - l1, r2 - l2, (r2 - l1) // 2)
            if l2 > r1 or most <= p:
                continue
            o = shift_of(ids, l1, l2, p)
            if o is None:
                continue
            q = np.arange((l2 - l1 - o) % p, most + 1, p)
            q = q[q > p]
            s, e = np.maximum(l1, l2 - q), np.minimum(r1, r2 - q) + q
            both = (l2 - q == l1) | (r2 - q == r1)  # both regions end here: the run may go on
            out.append(np.stack((s, e, q), 1)[(e - s >= 2 * q) & ~both])
            on = checked(ids, np.stack((s, q), 1)[both])
            out.append(np.array(on, np.int64).reshape(-1, 3))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def find_runs(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
    """All runs ``(start, end, period)`` of at least ``least`` words, by start and period.

    ``ids`` holds the word numbers of several texts, each followed by a number
    that stands nowhere else, so no run crosses a border.
    """
    found = small_periods(ids, 3 * BASE_SCALE)
    scale = BASE_SCALE
    grams = mix64(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    kept = np.arange(len(ids))

    def longer(h: np.ndarray, step: int) -> np.ndarray:
        nxt = np.zeros_like(h)
        nxt[:max(0, len(h) - step)] = h[step:]
        return mix64(h * np.uint64(0x9FB21C651E98DF25) + nxt)

    for step in (1 << k for k in range(BASE_SCALE.bit_length() - 1)):
        grams = longer(grams, step)
    while True:
        wide = lengths >= 6 * scale  # two periods of three scales at least
        if not wide.any():
            break
        stay = np.zeros(len(ids) + 1, np.int64)
        np.add.at(stay, starts[wide], 1)
        np.add.at(stay, starts[wide] + lengths[wide] + 1, -1)
        keep = np.cumsum(stay[:-1])[kept] > 0
        kept, grams = kept[keep], grams[keep]
        dull = np.zeros(len(ids) + 1, np.int64)
        tight = found[(found[:, 2] * 3 <= scale) & (found[:, 1] - found[:, 0] >= scale)]
        np.add.at(dull, tight[:, 0], 1)
        np.add.at(dull, tight[:, 1] - scale + 1, -1)
        sync = synchronising(grams, (np.cumsum(dull[:-1]) > 0)[kept], scale)
        context = longer(grams, scale)
        pairs = proposals(kept[sync], context[sync], scale)
        got = checked(ids, pairs)
        if got:
            found = np.concatenate((found, np.array(got, np.int64)))
        grams = context
        scale *= 2
    if len(found):
        found = np.concatenate((found, over_meeting_regions(ids, map(tuple, found.tolist()))))
    found = found[found[:, 1] - found[:, 0] >= np.maximum(least, 2 * found[:, 2])]
    # a stretch proposed with a multiple of its period is the same stretch again
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with their tail made periodic, for the documents whose id's checksum says so."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def describe(words: list[bytes], runs: np.ndarray) -> dict:
    """Result columns of one text from its runs (word numbers within the text)."""
    rows = [(int(s), int(e - s), int(q)) for s, e, q in runs]
    out: dict = {"n_runs": len(rows), "start": None, "length": None, "period": None, "exponent_milli": None}
    if rows:
        s, length, q = min(rows, key=lambda r: (-r[1], r[0], r[2]))
        out |= {"start": s, "length": length, "period": q, "exponent_milli": 1000 * length // q}
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 1], -1)
        gone = np.cumsum(drop[:-1]) > 0
        words = [w for w, x in zip(words, gone) if not x]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in rows)
    collapsed = b" ".join(words)
    return out | {"runs": [{"start": s, "length": length, "period": q} for s, length, q in rows],
                  "collapsed": collapsed.decode(), "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
                  "collapsed_sha256": hashlib.sha256(collapsed).hexdigest()}


COLUMNS = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")
LISTS = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = 12, plant: bool = False, lists: bool = True) -> DataFrame:
    """Runs of every row of ``docs`` (doc_id, text): one row per row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` lists all runs
    of ``least`` words or more by start and period, ``collapsed`` is the text
    without the words that a run repeats after its first period, joined by
    blanks; ``lists=False`` leaves both out. ``plant=True`` first makes the
    tails of some documents periodic, chosen by crc32 of the id (a null id:
    none). Null, empty and blank texts have no words, no run, and the digest of
    the empty string; repeated rows each give a row; rows that share an id are
    told apart; other columns are ignored. A map over rows, no shuffle: a task
    holds one slice of rows and arrays of the slice's words.
    """
    names = [f.split()[0] for f in COLUMNS.split(", ")] + (["runs", "collapsed"] if lists else [])

    def run(batch: pa.RecordBatch):
        doc_ids = batch.column("doc_id").to_pylist()
        words = [planted(t.split(), d) if plant else t.split() for t, d in zip(texts(batch), doc_ids)]
        number: dict = defaultdict(count().__next__)
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        ids = np.zeros(int((lengths + 1).sum()), np.int64)
        for w, s in zip(words, starts):
            ids[s:s + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
        ids[starts + lengths] = len(number) + np.arange(len(words))
        runs = find_runs(ids.astype(np.int32), starts, lengths, least)
        at = np.searchsorted(runs[:, 0], np.append(starts, len(ids)))
        rows = [describe(w, runs[at[k]:at[k + 1]] - np.array([starts[k], starts[k], 0])) for k, w in enumerate(words)]
        yield {"doc_id": batch.column("doc_id"), **{c: [r[c] for r in rows] for c in names}}

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run,
                     f"doc_id long, {COLUMNS}" + (f", {LISTS}" if lists else ""))
