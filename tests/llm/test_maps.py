"""op4, op6, op7, op9 and op10 against brute force, and their awkward cases."""

import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm.fixtures import ROWS, documents, labels, prose
from ticketscope.llm import pu
from ticketscope.llm.html_tree import extract, main_text
from ticketscope.llm.lengths import at_limits, encoded_lengths, histogram, quantiles, sums, token_report
from ticketscope.llm.licenses import BASE, automaton, evaluate, longest_postfix, scan, scan_licenses, to_postfix
from ticketscope.llm.tokens import VOCABULARY, encoder, n_ids
from ticketscope.llm.training_order import materialise, permute, read_slots, round_keys


# -- token counts ------------------------------------------------------------

def plain_encoder():
    return encoder(open(VOCABULARY, "rb").read())


def test_length_histogram_matches_brute_force(spark):
    enc = plain_encoder()
    n = sorted(len(enc.encode_ordinary(r[1] or "")) for r in ROWS)
    rows = {r.n_tokens: r for r in token_report(documents(spark)).collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(n)
    for k, r in rows.items():
        assert r.docs_upto == sum(x <= k for x in n) and r.tokens_upto == sum(x for x in n if x <= k)
        assert r.docs_from == sum(x >= k for x in n) and r.tokens_from == sum(x for x in n if x >= k)
        assert r.truncated_total == sum(min(x, k) for x in n) and r.n_cut == sum(x > k for x in n)
        assert r.share_upto == pytest.approx(sum(x <= k for x in n) / len(n))
    hist = histogram(encoded_lengths(documents(spark)))
    for r in at_limits(hist, [0, 1, 17, 512, 4096, 10 ** 9]).collect():
        assert r.truncated_total == sum(min(x, r.context) for x in n) and r.n_cut == sum(x > r.context for x in n)
    for r in quantiles(sums(hist), [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == n[max(0, int(np.ceil(r.share * len(n))) - 1)]


def test_length_histogram_of_empty_table(spark):
    assert token_report(documents(spark, [])).count() == 0
    hist = histogram(encoded_lengths(documents(spark, [])))
    assert [tuple(r) for r in at_limits(hist, [5]).collect()] == [(5, 0, 0)]
    assert quantiles(sums(hist), [0.5]).first().n_tokens is None


def test_tokenizer_round_trip():
    enc = plain_encoder()
    for r in ROWS:
        assert enc.decode(enc.encode_ordinary(r[1] or "")) == (r[1] or "")


# -- positive-unlabelled quality ---------------------------------------------

def junk(i):
    return ["w### " * 50 + prose(i, 20), "LOUD WORDS!! " * 30, prose(i, 2) + " again" * 80, " | ".join(prose(i, 60).split())][i % 4]


def pu_corpus():
    rows = [(i, junk(i) if i % 5 == 4 else prose(i, 40 + i % 90), "en", "a") for i in range(400)]
    return rows, [(i, int(i % 5 != 4), 0) for i in range(0, 400, 2)]


def test_quality_separates_held_out_documents(spark):
    rows, known = pu_corpus()
    got = {r.doc_id: r for r in pu.quality(documents(spark, rows), labels(spark, known)).collect()}
    import zlib
    held = [d for d in got if got[d].held_out]
    assert set(held) == {d for d in got if zlib.crc32(str(d).encode()) % 5 == 0}
    right = [got[d].predicted == int(d % 5 != 4) for d in held]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_prior_is_estimated(spark):
    rows, known = pu_corpus()
    model = pu.fit(pu.coded(documents(spark, rows)), labels(spark, known))
    assert model.prior == pytest.approx(0.8, abs=0.08)


def test_moments_and_minimum(spark):
    rows, known = pu_corpus()
    table = pu.coded(documents(spark, rows)).selectExpr("codes", "doc_id % 5 <> 4 as positive")
    m = pu.moments(table)
    x = pu.design([r.codes for r in table.collect()])
    y = np.array([r.positive for r in table.collect()])
    assert np.array_equal(m.unl, x.T @ x) and np.array_equal(m.pos, x[y].T @ x[y])

    def risk(w):
        g = x @ w
        rest = np.mean((1 + g) ** 2) - 0.8 * np.mean((1 + g[y]) ** 2)
        return 0.8 * np.mean((1 - g[y]) ** 2) + max(0, rest) + 1e-3 * w @ w

    w = pu.minimise(m, 0.8)
    r = np.random.default_rng(0)
    assert all(risk(w) <= risk(w + 0.02 * r.standard_normal(len(w))) for _ in range(50))


def test_quality_awkward_rows(spark):
    docs = documents(spark)
    lab = labels(spark, [(0, 1, 0), (1, 1, 0), (8, 1, 0), (8, 0, 0), (None, 1, 0), (12, None, None), (99, 1, 0), (11, 0, 0)])
    got = pu.quality(docs, lab)
    assert got.count() == docs.count() and got.where("score is null or held_out is null or predicted is null").count() == 0
    flat = pu.quality(docs, labels(spark, [])).collect()
    assert {(r.score, r.predicted) for r in flat} == {(0.5, 1)}
    assert pu.quality(documents(spark, []), lab).count() == 0
    kept = pu.keep_good(docs, labels(spark, []))
    assert kept.columns == docs.columns and kept.count() == docs.count()


# -- licences ----------------------------------------------------------------

def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spots = [(i, v) for i in range(len(w)) for k, v in BASE.items() if w[i:i + len(k.split())] == k.split()]
    at = [i for i, _ in spots]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in spots}))


def test_license_scan_matches_brute_force(spark):
    r = random.Random(2)
    bits = [*BASE, "under the", "mit", "license", "cc", "by", "nc", "Apache License, Version 2.0", "CC-BY-NC", "x_y", "é", "\n"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 40))), None, None) for i in range(200)] + list(ROWS)
    got = scan_licenses(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    have = Counter((x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got)
    assert have == Counter((d, *brute_base(t)) for d, t, *_ in rows)
    for x in got:
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert scan_licenses(documents(spark, [])).count() == 0


def test_license_tags():
    a = automaton()
    x = scan(b"// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND BSD-3-Clause\ncode", a)
    assert x["labels"] == "bsd-3-clause,gpl-3,mit" and x["score"] == 0.9 and x["n_base"] == 0
    x = scan(b"Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", a)
    assert x["base_labels"] == "apache-2" and x["labels"] == "apache-2,gpl-2" and x["score"] == pytest.approx(0.5)
    assert scan(b"this is licensed under cc by nc sa", a)["labels"] == "cc-by-nc,cc-by-nc-sa"
    assert scan(b"GNU General Public License, version 3", a)["labels"] == "gpl-3"
    assert scan(b"", a) == {"n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "",
                            "labels": "", "score": 0.0, "expressions": []}


def test_shunting_yard_precedence():
    assert to_postfix("a or b and c with d".split()) == "a b c d with and or".split()
    assert to_postfix("( a or b ) and c".split()) == "a b or c and".split()
    for bad in ("a b", "( a", "a )", "and a", "a or", "( )", ""):
        assert to_postfix(bad.split()) is None
    assert evaluate("MIT */ and then some text") == ({"mit"}, 0.9)
    assert evaluate("()") is None


def test_expressions_of_any_length():
    names = [f"lic-{i}" for i in range(500)]
    want = {*names, "agpl"}
    assert evaluate(" AND ".join([*names, "AGPL-3.0-only"])) == (want, 0.3)
    assert evaluate("(" * 300 + " OR ".join([*names, "AGPL-3.0-only"]) + ")" * 300 + " some more") == (want, 0.5)
    assert evaluate(" OR ".join(names) + " AND (AGPL-3.0-only OR")[0] == set(names)
    assert evaluate("MIT " * 100_000) == ({"mit"}, 0.9)


def test_longest_valid_beginning():
    """Against the shunting-yard tried on every beginning, longest first."""
    def value(tokens):  # a full parse by descent; None if the tokens are no expression
        def level(i, ops):
            if not ops:
                if i < len(tokens) and tokens[i] == "(":
                    x, i = level(i + 1, ["or", "and", "with"])
                    return (x, i + 1) if i < len(tokens) and tokens[i] == ")" else (None, len(tokens) + 1)
                return (tokens[i], i + 1) if i < len(tokens) and tokens[i] not in ("(", ")", "or", "and", "with") else (
                    None, len(tokens) + 1)
            x, i = level(i, ops[1:])
            while i < len(tokens) and tokens[i] == ops[0]:
                y, i = level(i + 1, ops[1:])
                x = (x, y, ops[0])
            return x, i
        x, i = level(0, ["or", "and", "with"])
        return x if i == len(tokens) else None

    def flat(x):
        return [x] if isinstance(x, str) else [*flat(x[0]), *flat(x[1]), x[2]]

    r = random.Random(4)
    for _ in range(3000):
        tokens = [r.choice(["a", "b", "c", "a", "b", "or", "and", "or", "and", "with", "(", ")"]) for _ in range(r.randint(0, 14))]
        n = next((k for k in range(len(tokens), 0, -1) if value(tokens[:k]) is not None), 0)
        assert longest_postfix(tokens) == (flat(value(tokens[:n])) if n else [], n)


# -- training order ----------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 256, 1000, 4097])
def test_feistel_is_a_permutation(n):
    keys = round_keys("k")
    p = permute(np.arange(n), n, keys)
    assert sorted(p) == list(range(n))
    if n > 100:
        assert (p != permute(np.arange(n), n, round_keys("other"))).any()
        assert np.abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.2


def test_shards_round_trip(spark):
    docs = documents(spark).repartition(4)
    enc, end = plain_encoder(), n_ids(open(VOCABULARY, "rb").read())
    want = Counter()
    for d, t, *_ in ROWS:
        ids = [*enc.encode_ordinary(t or ""), end]
        for c in range(0, len(ids), 64):
            want[(d, c // 64, tuple(ids[c:c + 64]))] += 1
    shards = materialise(docs, "key", seq_len=64, shard_slots=50).cache()
    meta = sorted((r.shard, r.first_slot, r.n_sequences, r.stride, len(r.payload)) for r in shards.collect())
    n = sum(want.values())
    assert [m[0] for m in meta] == list(range(-(-n // 50)))
    assert all(first == s * 50 and size == k * stride and k == min(50, n - first) for s, first, k, stride, size in meta)
    rows = read_slots(shards).collect()
    assert sorted(r.slot for r in rows) == list(range(n))
    assert Counter((r.doc_id, r.chunk, tuple(r.ids)) for r in rows) == want
    part = read_slots(shards, 30, 120).collect()
    assert sorted(r.slot for r in part) == list(range(30, 120))
    again = materialise(documents(spark).repartition(2), "key", seq_len=64, shard_slots=50)
    assert {r.shard: r.crc32 for r in again.collect()} == {r.shard: r.crc32 for r in shards.collect()}
    other = materialise(docs, "other key", seq_len=64, shard_slots=50)
    assert {r.shard: r.crc32 for r in other.collect()} != {r.shard: r.crc32 for r in shards.collect()}
    assert materialise(documents(spark, []), "key").count() == 0


# -- page text ---------------------------------------------------------------

def test_main_text_of_pages():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><p>Site name, slogan, and so on</p></header><nav><ul><li><a href="/a">A, b, c</a></li></ul></nav>
    <div class="ad"><p>Buy now, buy here, buy more.</p></div>
    <article><header><h1>Head &amp; line</h1></header><p>First  paragraph,
    with   blanks, and <a href="x">a link</a>.<p>Second &lt;one&gt;, unclosed <b>bold<p>Third, last.</p>
    <aside>Related stuff, more.</aside><form><p>Subscribe, please, now</p></form></article>
    <section id="comments"><p>I like it, really, a lot, thanks, bye.</p></section>
    <div class="cookie-notice">We use cookies, ok?</div><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == ("Head & line\nFirst paragraph, with blanks, and a link.\nSecond <one>, unclosed bold\n"
                               "Third, last.")


def test_main_text_without_semantic_tags():
    body = "".join(f"<p>{prose(i, 60)}</p>" for i in range(5))
    page = (f'<div id="menu"><a href=a>x</a> <a href=b>y</a></div><div id="wrap"><div class="col">{body}</div>'
            '<div class="sidebar"><p>Latest, news, here, now, and, more</p></div><div><a href=1>Next, page, one</a></div></div>')
    assert main_text(page) == "\n".join(prose(i, 60) for i in range(5))


@pytest.mark.parametrize("tag", ["article", "main", 'div role="main"', "div", "body"])
def test_main_text_of_a_sectioned_article(tag):
    """A long section outscores its article; all other blocks stay."""
    long = [f"Part {i}, " + "and, so, on, " * 2 + "x" * 400 for i in range(12)]
    page = (f'<nav><a href=a>Menu</a></nav><{tag}><h1>Title</h1><p>Lead.</p><h2>One</h2><section><h3>Inner</h3>'
            + "".join(f"<p>{x}</p>" for x in long) + "</section><h2>Two</h2><section><p>A short one, at the end.</p></section>"
            "<ul><li>first</li><li>second</li></ul><table><tr><td>cell</td></tr></table><pre>code</pre>"
            f"<blockquote>Quoted.</blockquote><aside>Related</aside></{tag.split()[0]}><footer>&copy; us</footer>")
    assert main_text(page) == "\n".join(["Title", "Lead.", "One", "Inner", *long, "Two", "A short one, at the end.", "first",
                                         "second", "cell", "code", "Quoted."])


@pytest.mark.parametrize("tag", ["article", "div"])
def test_main_text_of_unequal_divs(tag):
    long = "A, b, c, " * 30 + "and so on"
    assert main_text(f"<body><{tag}><div>{long}</div><div>Short.</div></{tag}></body>") == f"{long}\nShort."


def test_attribute_values_of_any_length():
    for quote in "\"'":
        value = "a > b, <p>c</p> " * 20_000
        assert main_text(f"<article><p data-x={quote}{value}{quote} id=x>One</p><p>Two</p></article>") == "One\nTwo"
    assert main_text("<article><p title='a>One</p><p>Two, it is.</p></article>") == "One\nTwo, it is."  # never closed
    assert main_text("<article><p don't>One</p><p>Two, isn't it.</p></article>") == "One\nTwo, isn't it."
    main_text("<p title='a\">" * 50_000)             # quotes that pair across tags
    main_text("<p title='>" + "<p title=\">" * 50_001)
    main_text("<p a='>'" * 50_000)                   # every > inside a value


def test_words_inside_attribute_values():
    assert main_text("""<article><p data-x='<svg class="menu" hidden role=menu>' title="a hidden gem">One</p>
        <p data-id=menu>Two</p><p class="menu">Not this</p><p hidden>Nor this</p></article>""") == "One\nTwo"


def test_captions_and_formulas_stay():
    page = ("<article><p>Text.</p><figure><img src=a><figcaption>A caption.</figcaption></figure>"
            "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><svg><text>no</text></svg></article>")
    assert main_text(page) == "Text.\nA caption.\nLet x=1 be."


def test_main_text_awkward():
    assert main_text(None) == main_text("") == main_text("<nav><a>x</a></nav>") == ""
    assert main_text("plain text, no markup") == "plain text, no markup"
    assert main_text("<p>a &lt b &am c &#x41;&nbsp;d</p>") == "a < b &am c A d"
    assert main_text("<article><p>one</p><!-- never closed") == "one"
    assert main_text("<article><p title='a>b'>x</p><p>" + "<b>" * 3000 + "deep") == "x\ndeep"
    main_text("<a " + "b" * 50_000)                 # no end of tag
    main_text('<p class="' + "x " * 50_000)         # no end of attribute


def test_pages_table(spark):
    rows = [(1, "u", "<article><p>A, b.</p></article>", 5), (1, "u", "<article><p>A, b.</p></article>", 5), (None, None, None, 6), (2, None, "", 7)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"))
    assert Counter(map(tuple, got.collect())) == Counter({(1, "u", "A, b.", 5): 2, (None, None, "", 0): 1, (2, None, "", 0): 1})
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_registered_pages_match_the_articles(spark, sf):
    """The pages' article elements, cut out by hand."""
    import html as H
    from ticketscope.llm.queries import QUERIES
    pages = dict(duckdb.connect().execute(f"select page_id, html from read_parquet('{sf}/pages.parquet')").fetchall())
    got = QUERIES["op10_html_tree"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        h = pages[r.page_id]
        inner = h[h.index("<article>"):h.index("</article>")]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(filter(None, parts)) and r.n_chars == len(r.text)


ARTICLE = "<h1>Title</h1>" + "".join(f"<p>{prose(i, 40)}</p>" for i in range(3))
MAIN = "\n".join(["Title", *(prose(i, 40) for i in range(3))])


@pytest.mark.parametrize("names", [
    "comment-content", "sidebar-content", "main-menu", "page-footer", "newsletter-body", "adbox", "sharebar", "commentsection",
    "relatedlinks", "related-content", "cookie-text", "mainMenu", "commentList", "notice-body", "sponsored-post", "topnav", "hidden"])
@pytest.mark.parametrize("where", ["inside", "beside"])
def test_furniture_whatever_stands_beside_its_word(names, where):
    extra = f'<div class="{names}"><p>{prose(9, 30)}</p></div>'
    page = f"<article>{ARTICLE}{extra}</article>" if where == "inside" else f"<body><article>{ARTICLE}</article>{extra}</body>"
    assert main_text(page) == MAIN


@pytest.mark.parametrize("tag", ['article class="comment"', 'article class="comment-body" id="div-comment-3"',
                                 'article itemprop="comment"', 'div role="comment"',
                                 'section id="comments"', 'div class="user-comments"'])
def test_reader_comments_in_any_element(tag):
    name = tag.split()[0]
    page = f"<body><article>{ARTICLE}</article><{tag}><h2>Two comments</h2><p>{prose(7, 60)}</p><p>{prose(8, 60)}</p></{name}></body>"
    assert main_text(page) == MAIN


@pytest.mark.parametrize("tag", ['section id="community"', 'section id="legal"', 'div class="tools"', 'section id="related-work"'])
def test_sections_named_like_furniture_stay(tag):
    name = tag.split()[0]
    part = f"<{tag}><h2>Related work</h2><p>{prose(5, 30)}</p></{name}>"
    assert main_text(f"<article>{ARTICLE}{part}</article>") == f"{MAIN}\nRelated work\n{prose(5, 30)}"
    links = f'<{tag}><h2>Related work</h2><p><a href=x>{prose(5, 30)}</a></p></{name}>'
    assert main_text(f"<article>{ARTICLE}{links}</article>") == MAIN


@pytest.mark.parametrize("names", ["content-sidebar-wrap", "main has-sidebar", "page with-menu", "post category-social tag-cookies",
                                   "comments-open", "elementor-widget"])
def test_wrappers_of_the_article_stay(names):
    assert main_text(f'<body><div class="{names}"><article class="{names}">{ARTICLE}</article></div></body>') == MAIN
    assert main_text(f'<body><div class="{names}">{ARTICLE}</div></body>') == MAIN


def test_headings_with_ids_stay():
    assert main_text('<article><h2 id="comments">Comments on it</h2><p>Text, here.</p></article>') == "Comments on it\nText, here."


@pytest.mark.parametrize("text, labels, score", [
    ("the licence of this file", "", 0.0), ("see LICENSE", "", 0.0), ("MIT and see the file", "mit", 0.9), ("MIT.", "mit", 0.9),
    ("GPLv2+", "gpl-2", 0.4), ("Apache-2.0 WITH LLVM-exception OR the rest", "apache-2", 1.0),
    ("LicenseRef-Acme-1", "licenseref-acme-1", 0.5), ("NOASSERTION", "", 0.0), ("Zlib OR X11", "x11,zlib", 0.9),
    ("EPL-2.0 AND (MIT OR see)", "epl-2", 0.5)])
def test_only_identifiers_become_licences(text, labels, score):
    x = scan(f"// SPDX-License-Identifier: {text}".encode(), automaton())
    assert x["labels"] == labels and x["score"] == pytest.approx(score)


def test_shard_files_resume_at_any_slot(spark, tmp_path):
    from ticketscope.llm.training_order import read_slots_from_files, shard_name, write_shards
    shards = materialise(documents(spark), "key", seq_len=64, shard_slots=50).cache()
    folder = str(tmp_path / "shards")
    index = write_shards(shards, folder)
    assert sorted(os.listdir(folder)) == sorted(["_index", *(shard_name(r.shard) for r in shards.select("shard").collect())])
    for r in shards.collect():
        body = open(f"{folder}/{shard_name(r.shard)}", "rb").read()
        assert body == bytes(r.payload) and len(body) == r.n_sequences * r.stride
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert key(read_slots_from_files(index, folder)) == key(read_slots(shards))
    for start, stop in ((0, 10), (37, 120), (49, 51), (120, None)):
        assert key(read_slots_from_files(index, folder, start, stop, block_slots=7)) == key(read_slots(shards, start, stop))
    last = max(r.shard for r in shards.collect())
    for x in range(last):  # a reader that resumes in the last shard opens no other file
        os.truncate(f"{folder}/{shard_name(x)}", 0)
    first = last * 50
    assert key(read_slots_from_files(index, folder, first)) == key(read_slots(shards, first))
    index = write_shards(shards, folder)  # again over a folder with damaged files
    assert key(read_slots_from_files(index, folder)) == key(read_slots(shards))
    none = write_shards(materialise(documents(spark, []), "key"), str(tmp_path / "none"))
    assert none.count() == 0 and read_slots_from_files(none, str(tmp_path / "none")).count() == 0
