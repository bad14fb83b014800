"""op12 against regular expressions, and its awkward cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import ROWS, documents
from ticketscope.llm.automata import compile_patterns
from ticketscope.llm.secrets import BORDER, RULES, compile_rules, find_secrets, scan_secrets, states_backwards

ASSIGN = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BITS = ["password", "token", "Secret", "api_key", "APIKEY", "passwd", '"', "'", " ", "=", ":", "abc12345", "AKIA", "AKIAABCDEFGHIJKL",
        "0123456789abcdef" * 2, "deadbeef", "x", "\n", "é", "ghp_", "a1B2" * 6, "xoxb-", "1234567890", "AIza", "eyJ", "eyJhbGciOi", ".",
        "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "https://", "user", ":pw", "@host", "sk_live_", "ſ", "K", "日本"]


def plain(text):
    """(start, end, kind) of every rule by the regex module, in code points."""
    out = []
    for k, r in enumerate(RULES):
        if r.kind == "assign":
            found = [(m, m[2]) for m in ASSIGN.finditer(text) if m[1].isascii()]
        elif r.kind in ("access", "hex"):
            least = {"access": 16, "hex": 32}[r.kind]
            found = [(m, m[0]) for m in re.finditer({"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}[r.kind], text) if len(m[0]) >= least]
        else:
            found = [(m, m["value"]) for m in re.finditer(f"(?:{r.lead})(?P<value>{r.value})", text)]
        out += [(m.start(), m.end(), k) for m, v in found if len(v) >= r.least]
    return sorted(out, key=lambda x: (x[0], x[2]))


def scanned(text):
    raw = text.encode()
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[s]), int(points[e]), k) for s, e, k in find_secrets(raw, compile_rules())]


def test_spans_match_regular_expressions():
    r = random.Random(7)
    for _ in range(1500):
        text = "".join(r.choice(BITS) for _ in range(r.randrange(40)))
        assert scanned(text) == plain(text), text


def test_each_kind_is_found():
    text = ("token = 'abcdefgh1' AKIAABCDEFGHIJKL " + "0a" * 16 + " ghp_" + "aB3" * 10 + " xoxb-1234567890-abc AIza" + "x" * 35
            + " sk_live_" + "9" * 20 + " eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.sig-nature12 -----BEGIN RSA PRIVATE KEY----- https://me:pw@host")
    assert {RULES[k].kind for _, _, k in scanned(text)} == {r.kind for r in RULES}


@pytest.mark.parametrize("pattern", ["a(b|cd)*e", "[^a-c]+x{2,3}", "(?i)key_?\\d+", "a?b?c?d", "(ab|a)(bc|c)", "x{3}", "\\x41[\\]\\-z]+"])
@settings(max_examples=40, deadline=None)
@given(text=st.text("abcdeKkey_19xzA]-", max_size=25))
def test_automaton_accepts_what_the_expression_matches(pattern, text):
    forward, mirrored = compile_patterns([pattern]), compile_patterns([pattern], backwards=True, anywhere=True)
    state = 0
    for b in text.encode():
        state = forward.step[state * forward.width + forward.byte_class[b]]
    assert bool(forward.tags[state]) == bool(re.fullmatch(pattern, text))
    states = states_backwards(text.encode(), mirrored) if text else []
    assert [bool(mirrored.tags[s]) for s in states] == [bool(re.match(pattern, text[i:])) for i in range(len(text))]


def test_automaton_is_minimal():
    a = compile_patterns(["(a|b)*abb"])
    assert len(a.tags) == 4 + (a.dead >= 0)
    with pytest.raises(ValueError):
        compile_patterns(["(a"])


def test_lanes_agree_with_one_pass():
    """Matches over many lanes and long runs read across their borders."""
    c = compile_rules()
    text = ("0123456789abcdef" * 2000 + " token=" + "a" * 5000 + " x" * 3000 + "ab" * 40).encode()
    state, want = 0, []
    for b in text[::-1]:
        state = int(c.mirrored.step[state * c.mirrored.width + c.mirrored.byte_class[b]])
        want.append(state)
    assert states_backwards(text, c.mirrored).tolist() == want[::-1]
    assert find_secrets(b"token=" + BORDER + b"abcdefgh12", c) == []


def test_rows_match_brute_force(spark):
    r = random.Random(3)
    rows = ROWS + [(i, "".join(r.choice(BITS) for _ in range(60)), "en", "a") for i in range(200, 260)]
    want = []
    for d, text, *_ in rows:
        spans = [(RULES[k].kind, s, e) for s, e, k in plain(text or "")]
        base = [x for x in spans if x[0] in ("assign", "access", "hex")]
        say = lambda xs: ",".join(f"{a}:{b}:{c}" for a, b, c in xs)
        want.append((d, *[sum(x[0] == k for x in spans) for k in ("assign", "access", "hex")],
                     hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
    got = scan_secrets(documents(spark, rows), lists=False).collect()
    order = lambda row: (row[0] is not None, row[0] or 0, row[4], row[5])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_found_values_and_empty_table(spark):
    row = scan_secrets(documents(spark, [(1, "é token: 'abcdefgh9' ü", "en", "a")])).first()
    assert [tuple(x) for x in row.found] == [("assign", 2, 19, "token: 'abcdefgh9")]
    assert scan_secrets(documents(spark, [])).count() == 0
