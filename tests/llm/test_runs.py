"""op11 against all periods of every text, and its awkward cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import ROWS, documents, words
from ticketscope.llm.runs import BASE_SCALE, find_runs, periodic_runs, proposals, synchronising


def brute_runs(x, least):
    """Every period compared with the text's shift."""
    out = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def found_runs(lists, least=12):
    lengths = np.array([len(x) for x in lists], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    ids = np.zeros(int((lengths + 1).sum()), np.int32)
    for x, s in zip(lists, starts):
        ids[s:s + len(x)] = x
    ids[starts + lengths] = 10 ** 6 + np.arange(len(lists))
    runs = find_runs(ids, starts, lengths, least)
    at = np.searchsorted(runs[:, 0], np.append(starts, len(ids)))
    return [[(int(s - starts[k]), int(e - starts[k]), int(q)) for s, e, q in runs[at[k]:at[k + 1]]] for k in range(len(lists))]


def awkward(r):
    n = r.randrange(420)
    kind = r.randrange(6)
    if kind == 0:
        return [r.randrange(2) for _ in range(n)]
    if kind == 1:  # Fibonacci words
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 2:  # regions of one small period that meet out of step
        root = [r.randrange(3) for _ in range(r.randrange(1, 6))]
        return [root[(o + i) % len(root)] for o in (r.randrange(5) for _ in range(r.randrange(2, 5))) for i in range(r.randrange(5, 200))]
    if kind == 3:  # repetitions of repetitions
        x = [r.randrange(4) for _ in range(r.randrange(1, 5))]
        for _ in range(3):
            x = x * r.randrange(2, 5) + [r.randrange(4) for _ in range(r.randrange(3))]
        return x[:600]
    if kind == 4:  # one long period between other words
        p = r.randrange(20, 200)
        root = [r.randrange(50) for _ in range(p)]
        edge = [r.randrange(50) for _ in range(r.randrange(60))]
        return edge + [root[i % p] for i in range(r.randrange(p, 5 * p))] + edge
    root = [r.randrange(3) for _ in range(r.randrange(1, 5))]
    block = [root[i % len(root)] for i in range(r.randrange(24, 150))] + [r.randrange(3) for _ in range(r.randrange(6))]
    return (block * 5)[r.randrange(len(block)):][:r.randrange(2 * len(block), 4 * len(block))]


@pytest.mark.parametrize("seed", range(20))
def test_runs_match_all_periods(seed):
    r = random.Random(seed)
    lists = [awkward(r) for _ in range(12)]
    assert found_runs(lists) == [brute_runs(x, 12) for x in lists]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=150), min_size=1, max_size=4))
def test_runs_of_any_lists(lists):
    assert found_runs(lists) == [brute_runs(x, 12) for x in lists]


def test_synchronising_set_is_consistent_and_dense():
    r = random.Random(1)
    x = [r.randrange(5) for _ in range(300)]
    ids, scale = x + [9] * 3 + x, BASE_SCALE
    grams = np.array([zlib.crc32(bytes(ids[i:i + scale])) * 2654435761 % 2 ** 63 for i in range(len(ids) - scale + 1)], np.uint64)
    at = set(synchronising(grams, np.zeros(len(grams), bool), scale).tolist())
    for i in range(len(x) - 2 * scale):  # equal 2 * scale words: both or neither
        assert (i in at) == (i + 303 in at)
    for i in range(len(ids) - 3 * scale + 2):  # no gap of a scale
        assert any(j in at for j in range(i, i + scale))


def test_proposals_are_three_to_six_scales_apart():
    at = np.array([0, 10, 24, 30, 47, 48, 96])
    got = proposals(at, np.zeros(len(at), np.uint64), 8)
    assert {tuple(x) for x in got.tolist()} == {(a, b - a) for a in at for b in at if 24 <= b - a < 48}


def plain_row(doc_id, text):
    x = words(text)
    n = len(x)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    number = {w: k for k, w in enumerate(dict.fromkeys(x))}
    runs = brute_runs([number[w] for w in x], 12)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for i, w in enumerate(x) if i not in gone)))


def key(row):
    return tuple((v is not None, v) if not isinstance(v, str) else v for v in row)


def test_rows_match_brute_force(spark):
    planted = [(i, " ".join(f"w{(i * 7 + k) % 97}" for k in range(80 + i)), "en", "a") for i in range(100, 160)]
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 30_000] + planted
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in planted)
    got = periodic_runs(documents(spark, rows), plant=True, lists=False)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_row(r[0], r[1]) for r in rows), key=key)


def test_long_text_lists_and_empty_table(spark):
    long = " ".join(f"v{k % 9_000}" for k in range(40_000))
    row = periodic_runs(documents(spark, [(1, "start " + long, "en", "a")])).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 1, 40_000, 9_000)
    assert [tuple(r) for r in row.runs] == [(1, 40_000, 9_000)]
    assert row.collapsed.split() == ["start"] + [f"v{k}" for k in range(9_000)]
    empty = periodic_runs(documents(spark, []), plant=True)
    assert empty.count() == 0 and "runs_sha256" in empty.columns
