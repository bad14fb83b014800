"""Licence scan: Aho-Corasick finds identifier tags and notice phrases in one
pass over each text; a shunting-yard parser evaluates the tags' expressions.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketscope.llm.common import map_arrow, texts

# Notice phrases (as words) and their labels. The base phrases
# count places; the others only add labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "boost software license": "bsl-1",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "all-rights-reserved",
    "proprietary and confidential": "all-rights-reserved",
    "creative commons zero": "cc0",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "bsd zero clause": "0bsd",
    "zlib license": "zlib",
    "postgresql license": "postgresql",
    "artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "sil open font license": "ofl",
    "gnu free documentation license": "gfdl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "open database license": "odbl",
    "business source license": "busl",
    "server side public license": "sspl",
}
# How freely a text under the label may be used, 1 without conditions.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "0bsd": 1.0,
    "mit": 0.9, "apache-2": 0.9, "bsd": 0.9, "bsd-2-clause": 0.9, "bsd-3-clause": 0.9, "isc": 0.9, "bsl-1": 0.9,
    "zlib": 0.9, "postgresql": 0.9, "artistic": 0.8, "afl": 0.8, "ms-pl": 0.8, "ofl": 0.7,
    "eupl": 0.5, "cddl": 0.6, "odbl": 0.5, "gfdl": 0.4, "osl": 0.4, "sspl": 0.2, "busl": 0.1,
    "cc-by": 0.8, "mpl": 0.6, "mpl-2": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5,
    "gpl": 0.4, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.1, "all-rights-reserved": 0.0,
}
#: Freedom of an identifier that is not in the table.
UNKNOWN = 0.5
#: What an exception (``with``) adds.
EXCEPTION = 0.1

TAG_WORDS = "spdx license identifier"
TAG = re.compile(rb"spdx-license-identifier\s*:[ \t]*([^\r\n]*)")
EXPRESSION = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
#: The first sign that no expression holds ends it (such as the end of a comment).
FOREIGN = re.compile(r"[^a-z0-9.+:()\s-]")
RANK = {"or": 1, "and": 2, "with": 3}
# Identifiers without a version number.
PLAIN = frozenset("afl agpl apache artistic beerware blessing bsd bsl cddl cecill cecill-b cecill-c curl eclipse epl eupl fair "
                  "gfdl gpl imagemagick intel isc latex2e lgpl libpng libtiff mit mit-0 mitnfa mpl mulan naist-2003 ncsa "
                  "newsletr ntp ofl openssl osl postgresql psf public-domain python qhull ruby sendmail sleepycat tcl "
                  "unlicense vim w3c wtfpl x11 xinetd xnet zend zlib".split())
#: Families whose names may go on with a version or variant.
FAMILY = re.compile(r"(?:afl|agpl|apache|artistic|bsd|bsl|cc|cddl|epl|eupl|gfdl|gpl|lgpl|mit|mpl|ms|ofl|osl|psf|public|python|"
                    r"unicode|zpl)(?:v?\d[a-z0-9.]*\+?|-[a-z0-9.+-]+)")
VERSIONED = re.compile(r"[a-z0-9][a-z0-9.]*(?:-[a-z0-9.]+)*-v?\d[a-z0-9.]*(?:-[a-z0-9.]+)*\+?")
REFERENCE = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")


def is_identifier(word: str, after_with: bool = False) -> bool:
    """Whether a word has the form of a licence identifier: a known one, a known
    family with a version or variant, any name with a version number, or a
    reference; after ``with`` an exception."""
    if after_with:
        return "exception" in word or "-" in word
    return word in PLAIN or word in FREEDOM or any(p.fullmatch(word) for p in (FAMILY, VERSIONED, REFERENCE))


def expression_tokens(text: str) -> list[str]:
    """Tokens of an expression up to the first word that no expression holds."""
    out: list[str] = []
    for t in EXPRESSION.findall(FOREIGN.split(text.lower(), maxsplit=1)[0]):
        if t not in RANK and t not in "()":
            t = t.rstrip(".:")  # the end of a sentence
            if not is_identifier(t, out[-1:] == ["with"]):
                break
        out.append(t)
    return out

#: Lower case for A-Z; every other ASCII byte that is no digit or letter becomes a blank.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32) for b in range(256))


def label_of(identifier: str) -> str:
    """Label of a tag's identifier: the family names of the notices, else the identifier itself."""
    x = re.sub(r"(-only|-or-later|\+)$", "", identifier)
    x = re.sub(r"^(agpl|apache|gpl|lgpl|mpl)-?v?(?=\d)", r"\1-", x)
    x = re.sub(r"(?<=\d)\.0$", "", x)
    x = re.sub(r"^(cc-by(?:-nc)?(?:-sa|-nd)?|cc0|lgpl|agpl)-\d.*$", r"\1", x)
    return re.sub(r"^(gpl-\d)\..*$", r"\1", x)


def longest_postfix(tokens: list[str]) -> tuple[list[str], int]:
    """Shunting-yard over the longest beginning of ``tokens`` that is an
    expression, and its number of tokens (0 if there is none): operators
    ``with`` over ``and`` over ``or``, left to right, with parentheses."""
    out: list[str] = []
    stack: list[str] = []
    opened = 0
    operand = True  # what must come next
    done, rest, end = 0, [], 0  # output, operators left and tokens where it was last complete
    for k, t in enumerate(tokens, 1):
        if t in RANK:
            if operand:
                break
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif t == "(":
            if not operand:
                break
            stack.append(t)
            opened += 1
        elif t == ")":
            if operand or not opened:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            opened -= 1
        else:
            if not operand:
                break
            out.append(t)
            operand = False
        if not operand and not opened:
            done, rest, end = len(out), stack[::-1], k
    return out[:done] + rest, end


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Postfix form of a licence expression. None if the tokens are no expression."""
    post, n = longest_postfix(tokens)
    return post if n and n == len(tokens) else None


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels and freedom of a licence expression: the better side of ``or``,
    the worse side of ``and``; ``with`` names an exception, no licence. A text
    that is no expression counts up to its longest valid beginning, which ends
    before the first word without the form of an identifier; None if there is
    none."""
    post, n = longest_postfix(expression_tokens(expression))
    if not n:
        return None
    stack: list[tuple[set[str], float]] = []
    for t in post:
        if t in RANK:
            (b, y), (a, x) = stack.pop(), stack.pop()
            if t == "with":
                stack.append((a, min(1.0, x + EXCEPTION)))
                continue
            few, many = sorted((a, b), key=len)
            many |= few
            stack.append((many, max(x, y) if t == "or" else min(x, y)))
        else:
            label = label_of(t)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    """Phrases with a blank on either side, over words joined by blanks."""
    a = ahocorasick.Automaton()
    for p in {*BASE, *NOTICES, TAG_WORDS}:
        a.add_word(f" {p} ", (p, len(p.split())))
    a.make_automaton()
    return a


def scan(text: bytes, a: ahocorasick.Automaton) -> dict:
    """Counts, labels and score of one text (UTF-8)."""
    low = text.translate(WORD_BYTES)
    words = low.split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    n_base, first, last, base, found = 0, None, None, set(), []
    at = n_at = 0  # blanks up to a place already counted
    tagged = False
    for end, (phrase, n) in a.iter(joined):
        n_at += joined.count(" ", at, end + 1)
        at = end + 1
        start = n_at - 1 - n  # the closing blank ends word n_at - 2
        if phrase in BASE:
            n_base += 1
            base.add(BASE[phrase])
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
        if phrase == TAG_WORDS:
            tagged = True
        if phrase in NOTICES:
            found.append((start, start + n, NOTICES[phrase]))
    labels, score = set(base), min((FREEDOM[x] for x in base), default=None)
    reach = -1
    for s, e, label in sorted(found, key=lambda x: (x[0], -x[1])):
        if e > reach:  # a notice inside a longer one says nothing of its own
            reach = e
            labels.add(label)
            score = FREEDOM[label] if score is None else min(score, FREEDOM[label])
    expressions = []
    if tagged:
        for m in TAG.finditer(text.lower()):
            got = evaluate(m[1].decode("utf-8", "replace"))
            if got is not None:
                expressions.append(m[1].decode("utf-8", "replace").strip())
                labels |= got[0]
                score = got[1] if score is None else min(score, got[1])
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
            "score": 0.0 if score is None else score, "expressions": expressions}


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, expressions array<string>")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence mentions of every row of ``docs`` (doc_id, text).

    ``n_base`` counts every place of a base phrase, overlaps included;
    ``first_word`` and ``last_word`` are null without one. ``labels`` adds the
    other notices (the longest at a place) and the identifiers of tags (a word
    without the form of an identifier ends an expression);
    ``score`` is the least freedom among them, 0 if nothing is found;
    ``expressions`` are the tags' expressions that parse. Null and empty texts
    have 0 words and no label; repeated rows each give a row; other columns are
    ignored. A map over rows, no shuffle.
    """
    made: list = []  # one automaton per task

    def run(batch: pa.RecordBatch):
        if not made:
            made.append(automaton())
        rows = [scan(t, made[0]) for t in texts(batch)]
        yield {"doc_id": batch.column("doc_id"),
               **{k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels",
                                                    "labels", "score", "expressions")}}

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, SCHEMA)
