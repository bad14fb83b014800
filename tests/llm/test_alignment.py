"""op13 against token-by-token alignment, and its awkward cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.fixtures import ROWS, documents
from ticketscope.llm import alignment
from ticketscope.llm.alignment import BYTE_VOCABULARY, FRAME, PIECE_VOCABULARY, align_tokenizers, byte_alphabet, merged, merge_run, pack, whole


def tokenizers_of():
    a = Tokenizer.from_file(BYTE_VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_VOCABULARY)


def plain_alignment(rows):
    """All rows as (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest), token by token."""
    a_tok, b_tok = tokenizers_of()
    alphabet = byte_alphabet()

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()

    counts, docs = Counter(), []
    for d, text, *_ in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        x = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
        y = [b_bytes(i) for i in b]
        raw = (" " + text).encode() if text else b""
        if b"".join(x) != raw or b"".join(y) != raw:
            a = b = x = y = []
        owner = [[k for k, t in enumerate(side) for _ in t] for side in (x, y)]
        links = list(dict.fromkeys(zip(*owner)))
        a_ends, b_ends = (set(np.cumsum([len(t) for t in side]).tolist()) for side in (x, y))
        groups, ga, gb, at = [], [], [], 0
        for i, j in links:
            ga += [i] * (i not in ga)
            gb += [j] * (j not in gb)
            at = min(sum(map(len, x[:i + 1])), sum(map(len, y[:j + 1])))
            if at in a_ends and at in b_ends:
                groups.append(",".join(str(a[k]) for k in ga) + "|" + ",".join(str(b[k]) for k in gb))
                ga, gb = [], []
        pairs = [(b[j], a[i]) for i, j in links]
        counts.update(pairs)
        docs.append((d, len(a), len(b), groups, pairs))
    most: dict = {}
    for (b, _), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(d, n_a, n_b, len(g), len(p), sum(counts[x] == most[x[0]] for x in p), sum(counts[x] for x in p),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n_a, n_b, g, p in docs]


def order(row):
    return row[0] is not None, row[0] or 0, row[1:]


ODD = [(50, "<|endoftext|> is text, <s> too </s> <unk>", "en", "a"), (51, "two  blanks\tand\nlines  ", "en", "a"), (52, "日本語 😀 ﬁ Å", "ja", "a"),
       (53, " leading", "en", "a"), (54, "x▁y", "en", "a"), (55, "\x00\x01", "en", "a")]


def short_rows():
    return [r for r in ROWS if r[1] is None or len(r[1]) < 3_000] + ODD


@pytest.mark.parametrize("fan, rows_a_run", [(64, 4096), (2, 3)])
def test_alignment_matches_brute_force(spark, monkeypatch, fan, rows_a_run):
    """Also with runs of three rows and merges of two runs, so that levels of merges follow each other."""
    monkeypatch.setattr(alignment, "FAN", fan)
    rows = short_rows()
    got = align_tokenizers(documents(spark, rows).repartition(4), with_groups=False) if fan == 64 else small_runs(spark, rows, rows_a_run)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(plain_alignment(rows), key=order)


def small_runs(spark, rows, n):
    """Many partitions make many runs."""
    return align_tokenizers(documents(spark, rows).repartition(max(1, len(rows) // n)), with_groups=False)


def test_long_text_is_aligned_whole(spark):
    (row,) = align_tokenizers(documents(spark, [r for r in ROWS if r[0] == 10])).collect()
    a, b = tokenizers_of()
    text = next(r[1] for r in ROWS if r[0] == 10)
    assert row.n_a == len(a.encode(" " + text, add_special_tokens=False).ids) and row.n_b == len(b.encode(text))
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.groups.count(";") == row.n_groups - 1
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256


def test_empty_table_and_texts_without_tokens(spark):
    assert align_tokenizers(documents(spark, [])).count() == 0
    rows = align_tokenizers(documents(spark, [(1, None, "en", "a"), (2, "", "en", "a")])).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_links, r.count_sum, r.groups_sha256, r.groups) for r in rows) == [
        (1, 0, 0, 0, 0, "", ""), (2, 0, 0, 0, 0, "", "")]


def test_runs_round_trip_and_merge():
    r = np.random.default_rng(1)
    lists = [np.unique(r.integers(0, 60_000, 40_000)) for _ in range(5)]
    blobs = [pack(k, np.ones(len(k), np.int64)) for k in lists]
    assert max(map(len, lists)) > FRAME
    for k, blob in zip(lists, blobs):
        assert (whole(blob, 2)[0] == k).all()
    want = Counter(np.concatenate(lists).tolist())
    assert list(merged(blobs)) == sorted(want.items())
    assert dict(zip(*whole(merge_run(blobs), 2).tolist())) == want
    assert merge_run([]) == b""


def test_byte_entries_encode_like_the_file():
    a, _ = tokenizers_of()
    enc, _ = alignment.byte_encoder(alignment.load(BYTE_VOCABULARY))
    for r in short_rows():
        text = " " + (r[1] or "")
        assert enc.encode_ordinary(text) == a.encode(text, add_special_tokens=False).ids
