"""op3, op5 and op8 against brute force, and their awkward cases."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from tests.llm.fixtures import ROWS, documents, prose
from ticketscope.llm import simhash
from ticketscope.llm.graph import components
from ticketscope.llm.repeats import find_repeats
from ticketscope.llm.simhash import digest, keep_one, links, near_duplicates
from ticketscope.llm.tiling import contaminated, drop_contaminated, tile


# -- SimHash -----------------------------------------------------------------

def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, near):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ks = sorted(keys)
    for i, a in enumerate(ks):
        for b in ks[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def near(a, b, k=2):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= k


def check_components(rows, got):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    root = brute_components({f for _, f in fps}, near)
    least = defaultdict(list)
    for d, f in fps:
        least[root[f]].append(d)
    ids = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    assert Counter(map(tuple, got)) == Counter((d, f"{f:016x}", ids[root[f]]) for d, f in fps)


def test_simhash_awkward_rows(spark):
    docs = documents(spark)
    got = digest(near_duplicates(docs)).collect()
    check_components([(r[0], r[1]) for r in ROWS], got)


def test_simhash_registered_query(spark, sf):
    from ticketscope.llm.queries import QUERIES
    rows = duckdb.connect().execute(f"select doc_id, text from read_parquet('{sf}/documents.parquet')").fetchall()
    check_components(rows, QUERIES["op3_simhash_near_dedup"](spark, sf).collect())


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("limit", [64, 1])
def test_links_join_exactly_the_near_fingerprints(spark, monkeypatch, bits, limit):
    """Chains, stars and dense balls; with a limit of 1 every list goes through variants."""
    monkeypatch.setattr(simhash, "PAIR_LIST", limit)
    r = random.Random(bits)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.add(x)
            for b in r.sample(range(64), r.choice([1, 1, 2, 3])):
                x ^= 1 << b
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {x: x for x in signed} | {n: m for n, m in components(links(df, bits)).collect()}
    assert got == brute_components(set(signed), lambda a, b: near(a, b, bits))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(1000, i) for i in range(1001, 1300)]
    odd = [(-5, -5), (-7, -6), (-6, -7), (-7, -6)]
    df = spark.createDataFrame(chain + star + odd, "u long, v long")
    got = dict(map(tuple, components(df).collect()))
    assert got == {**{i: 0 for i in range(51)}, **{i: 1000 for i in range(1000, 1300)}, -7: -7, -6: -7}


def test_simhash_keeps_one_of_each_group(spark):
    docs = documents(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(7) == 1 and 2 not in ids and 0 in ids and ids.count(8) == 2  # two texts under one id
    assert keep_one(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(docs, max_bits=3)


# -- string tiling -----------------------------------------------------------

def brute_tiles(item, doc, k):
    """Greedy tiling by trying every pair of starts."""
    ui, ud, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                       and i + n not in ui and d + n not in ud):
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (i, d, n)
        if best is None:
            return sorted(out)
        ui |= set(range(best[0], best[0] + best[2]))
        ud |= set(range(best[1], best[1] + best[2]))
        out.append(best)


def test_tiles_match_brute_force():
    r = random.Random(3)
    for _ in range(150):
        item = [r.randint(1, 6) for _ in range(r.randint(0, 25))]
        doc = [r.randint(1, 6) for _ in range(r.randint(0, 40))]
        a, b = tile(item, doc, 3), brute_tiles(item, doc, 3)
        assert sum(n for *_, n in a) == pytest.approx(sum(n for *_, n in b), abs=3)  # ties may be cut elsewhere
        assert max((n for *_, n in a), default=0) == max((n for *_, n in b), default=0)
        for i, d, n in a:
            assert item[i:i + n] == doc[d:d + n]
        assert len({i + k for i, _, n in a for k in range(n)}) == sum(n for *_, n in a)
        assert len({d + k for _, d, n in a for k in range(n)}) == sum(n for *_, n in a)
    long = list(range(500))
    assert tile(long, [7] + long + [9], 5) == [(0, 1, 500)]


def test_contamination(spark):
    item = prose(77, 40)
    w = item.split()
    moved = " ".join(w[20:] + ["xx", "yy"] + w[:20])
    rows = [(1, prose(1, 200) + " " + item + " " + prose(2, 200), None, None),   # whole
            (2, "Intro " + item.upper().replace(",", ";"), "en", "a"),           # other case and signs
            (3, prose(3, 50) + " " + moved, "en", "a"),                          # reordered halves
            (4, " ".join(w[:20]) + " " + prose(4, 80), "en", "a"),               # half only
            (5, prose(5, 300), "en", "a"), (6, None, "en", "a"), (7, "", "en", "a"),
            (None, item, "en", "a"), (8, item, "en", "a"), (8, item, "en", "a"), (8, prose(8, 30), "en", "a")]
    bench = spark.createDataFrame([(1, item, "x"), (2, "too short text", "x"), (3, None, "x"), (4, "", "x"),
                                   (None, prose(88, 30), "x")], "item_id long, text string, n string")
    got = contaminated(documents(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter(
        {(1, 1): 1, (2, 1): 1, (3, 1): 1, (None, 1): 1, (8, 1): 2})
    by = {r.doc_id: r for r in got}
    assert by[1].first_word == 200 and by[1].n_tiles == 1 and by[1].coverage == 1.0
    assert by[3].n_tiles == 2 and by[3].longest_tile == 20
    docs = documents(spark, rows)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [4, 5, 6, 7]
    assert contaminated(documents(spark, []), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0
    assert contaminated(documents(spark), spark.createDataFrame([(None, prose(5, 60))], "item_id long, text string")).count() >= 1


def test_contamination_of_whole_items_found(spark, sf):
    """Every document that holds a test item word for word is reported."""
    from ticketscope.llm.queries import QUERIES
    con = duckdb.connect()
    rows = con.execute(f"select doc_id, text from read_parquet('{sf}/documents.parquet')").fetchall()
    bench = con.execute(f"select item_id, text from read_parquet('{sf}/benchmark.parquet')").fetchall()
    flat = {d: f" {' '.join(t.split())} " for d, t in rows}
    want = {(d, i) for i, t in bench for d, s in flat.items() if f" {' '.join(t.split())} " in s}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_string_tiling"](spark, sf).collect()}
    assert want and want <= got


def test_a_phrase_of_every_item_and_document_pairs_none(spark):
    from ticketscope.llm import tiling
    common = "this phrase stands in every text"
    items = spark.createDataFrame([(i, f"{prose(i, 20)} {common} {prose(100 + i, 20)}") for i in range(20)], "item_id long, text string")
    rows = [(i, f"{prose(500 + i, 30)} {common} {prose(900 + i, 30)}", "en", "web") for i in range(40)]
    rows += [(100 + i, f"{prose(700 + i, 5)} {prose(i, 20)} {common} {prose(100 + i, 20)}", "en", "web") for i in range(5)]
    docs = documents(spark, rows + rows[-1:])
    work = tiling.overlaps(docs, items, 5, 0.8)
    assert work.count() == 6  # five documents, one of them twice; no pair by the phrase alone
    got = Counter((r.doc_id, r.item_id, r.n_matched) for r in tiling.contaminated(docs, items).collect())
    assert {(d, i): n for (d, i, _), n in got.items()} == {(100, 0): 1, (101, 1): 1, (102, 2): 1, (103, 3): 1, (104, 4): 2}
    assert tiling.overlaps(docs, items, 5).count() == 46 * 20  # without a threshold every shared seed counts


def test_rare_seeds_lose_no_covered_item(spark):
    """Against the tiling of every pair, over few words so that seeds are shared widely."""
    from ticketscope.llm import tiling
    r = random.Random(9)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(i, text(r.randint(5, 30))) for i in range(25)]
    rows = [(i, text(r.randint(0, 60)), "en", "web") for i in range(30)]
    rows += [(50 + i, f"{text(4)} {x[len(x) // 2 + 1:]} zz {x[:len(x) // 2]}", "en", "web") for i, (_, x) in enumerate(items)]
    want = set()
    for d, t, *_ in rows:
        for i, x in items:
            a, b = tiling.word_hashes(x).tolist(), tiling.word_hashes(t).tolist()
            if sum(n for *_, n in tile(a, b, 5)) >= 0.8 * len(a):
                want.add((d, i))
    got = contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert want and {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)


# -- repeated byte strings ---------------------------------------------------

def brute_repeats(rows, length):
    first = {}
    for d, t in rows:
        b, k = (t or "").encode(), -1 << 63 if d is None else d
        for p in range(len(b) - length + 1):
            first[b[p:p + length]] = min(first.get(b[p:p + length], (k, p)), (k, p))
    out = Counter()
    for d, t in rows:
        b, k = (t or "").encode(), -1 << 63 if d is None else d
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < (k, p):
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()
        out[(d, len(b), sum(gone), spans, kept)] += 1
    return out


COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def repeat_rows():
    r = random.Random(5)
    shared = [prose(900 + i, 60) for i in range(5)]
    rows = [(r[0], r[1][:3000] if r[1] else r[1]) for r in ROWS]
    for i in range(60):
        parts = [prose(100 + i, r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randrange(0, 200)
            parts += [s[a:a + r.randint(90, 300)], prose(r.randint(0, 10 ** 6), 3)]
        rows.append((200 + r.randint(0, 45), " ".join(parts)))
    return rows + [(300, "ab" * 400), (301, "ab" * 150), (302, "é" * 200), (303, ("q" * 99)), (304, "q" * 100)]


@pytest.mark.parametrize("length,q", [(100, 32), (40, 16), (20, 20), (50, 8)])
def test_repeats_match_brute_force(spark, length, q):
    rows = repeat_rows()
    docs = documents(spark, [(*r, None, None) for r in rows]).repartition(5)
    got = find_repeats(docs, length, q)
    assert Counter(tuple(r) for r in got.select(*COLS).collect()) == brute_repeats(rows, length)


def test_repeats_across_pieces_of_a_text(spark, monkeypatch):
    """Texts longer than one hashed piece."""
    import ticketscope.llm.repeats as m
    text = prose(1, 30_000)
    n = 1 << m.CHUNK_BITS
    rows = [(1, text + text[:500]), (2, text[n // 4:n // 4 + 150_000])]
    assert len(text) > 60_000
    long = text * 8
    rows.append((3, long[:n + 5000]))
    got = {r.doc_id: r for r in find_repeats(documents(spark, [(*r, None, None) for r in rows]), 100).collect()}
    assert got[1].n_removed >= 500 and got[2].n_removed == got[2].n_bytes
    assert got[3].n_removed == got[3].n_bytes  # all of it stands in document 1 or earlier in itself
    assert got[3].n_spans == 1


def test_repeats_in_buckets_of_many_runs(spark, monkeypatch):
    """Buckets of more different runs than a task gathers: their strings are dealt by identifier."""
    import ticketscope.llm.repeats as m
    monkeypatch.setattr(m, "HOT", 2)
    rows = repeat_rows()
    got = find_repeats(documents(spark, [(*r, None, None) for r in rows]).repartition(5), 100, 32)
    assert Counter(tuple(r) for r in got.select(*COLS).collect()) == brute_repeats(rows, 100)


def test_repeats_settle_in_small_steps(spark, monkeypatch):
    import ticketscope.llm.repeats as m
    monkeypatch.setattr(m, "SETTLE_ROWS", 16)
    rows = repeat_rows()
    got = find_repeats(documents(spark, [(*r, None, None) for r in rows]).repartition(3), 100, 32)
    assert Counter(tuple(r) for r in got.select(*COLS).collect()) == brute_repeats(rows, 100)


def test_rows_without_an_id_keep_their_own_spans(spark):
    """Thousands of rows share the missing id; only their texts tell them apart."""
    from ticketscope.llm.repeats import _tagged
    rows = [(None, prose(50_000 + i, 25)) for i in range(3_000)] + [(None, "x" + "ab" * 200), (None, prose(7, 80)), (5, prose(7, 80))]
    got = Counter(tuple(r) for r in find_repeats(documents(spark, [(*r, None, None) for r in rows])).select(*COLS).collect())
    assert got == brute_repeats(rows, 100)
    tags = [r.tag for r in _tagged(documents(spark, [(*r, None, None) for r in rows])).collect()]
    assert len({t & 0xFFFFF for t in tags}) < len({r[1] for r in rows})  # 20 bits would not tell them apart


def test_refinement_ranks_equal_strings_alike():
    from ticketscope.llm.repeats import refine
    r = random.Random(3)
    runs = [bytes(r.choice(b"ab") for _ in range(r.randrange(20, 60))) for _ in range(40)] + [b"a" * 50] * 3
    bucket = np.array([r.randrange(4) for _ in runs], np.int64)
    run, place, rank = refine(bucket, runs, 20)
    strings = [(int(bucket[i]), runs[i][p:p + 20]) for i, p in zip(run, place)]
    assert len(strings) == sum(len(x) - 19 for x in runs)
    named = {}
    for s, k in zip(strings, rank.tolist()):
        assert named.setdefault(s, k) == k
    assert len(set(named.values())) == len(named)


def test_repeats_of_empty_table(spark):
    assert find_repeats(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        find_repeats(documents(spark), 100, 101)
