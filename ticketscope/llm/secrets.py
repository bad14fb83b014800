"""Secret scan: all rules compiled into one deterministic automaton.

The automaton of the mirrored rules reads a slice of texts once, from the last
byte to the first; a state's tags name the rules of which a match starts at the
byte just read. A second automaton, anchored, then reads the bytes of each match
forwards for its end (the longest) and for the place where its value begins.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketscope.llm.automata import Automaton, compile_patterns
from ticketscope.llm.common import map_arrow, texts


@dataclass(frozen=True)
class Rule:
    """A match is ``lead`` followed by ``value``, the longest from its start; it
    counts if the value has ``least`` characters or more. Matches of one rule do
    not overlap, from the left, those that do not count included."""

    kind: str
    lead: str
    value: str
    least: int = 1


# The base rules, in their order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 8),
    Rule("access", "AKIA", "[A-Z0-9]{12,}"),
    Rule("hex", "", "[0-9a-f]{32,}"),
)
# Published formats of further credentials.
MORE = (
    Rule("github", "(gh[pousr]|github_pat)_", "[A-Za-z0-9_]+", 22),
    Rule("slack", "xox[abeprs]-", "[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]+", 16),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("private_key", "", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY( BLOCK)?-----"),
    Rule("url_login", r"(https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20/:@]+:", r"[^\x00-\x20/:@]+@", 2),
)
RULES = BASE + MORE

#: Lanes that a slice is read in at a time, and the least bytes of one.
LANES, LEAST_LANE = 2048, 64
#: Between texts: a byte that UTF-8 does not use, so no match crosses it.
BORDER = b"\xff"


class Compiled(NamedTuple):
    mirrored: Automaton
    anchored: Automaton
    step: list[int]  # of the anchored one, for reading single bytes
    tags: list[int]
    rules: tuple[Rule, ...]


@lru_cache(maxsize=4)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Compiled:
    """Both automata of the rules; tag 2k of the anchored one is rule k's lead, 2k + 1 the whole of it."""
    whole = [r.lead + f"({r.value})" if r.lead else r.value for r in rules]
    leads = [r.lead for r in rules]
    anchored = compile_patterns([p for pair in zip(leads, whole) for p in pair])
    return Compiled(compile_patterns(whole, backwards=True, anywhere=True), anchored,
                    anchored.step.tolist(), anchored.tags.tolist(), rules)


def states_backwards(data: bytes, a: Automaton) -> np.ndarray:
    """State of ``a`` at each byte of ``data``, read from the last byte to the first.

    The bytes are cut into lanes that advance together. A lane first starts as
    if at a border; where the lane after it ends in another state, it is read
    again from there, until it meets the states already known.
    """
    n = len(data)
    length = max(LEAST_LANE, -(-n // LANES))
    lanes = -(-n // length)
    codes = np.frombuffer(data.translate(a.byte_class), np.uint8)[::-1]
    padded = np.full(lanes * length, a.byte_class[BORDER[0]], np.uint8)
    padded[:n] = codes
    columns = np.ascontiguousarray(padded.reshape(lanes, length).T.astype(np.int32))
    seen = np.zeros((length, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for k in range(length):
        state = a.step[state * a.width + columns[k]]
        seen[k] = state
    begun = np.zeros(lanes, np.int32)
    while True:
        want = np.concatenate((np.zeros(1, np.int32), seen[-1, :-1]))
        late = np.flatnonzero(want != begun)
        if not len(late):
            break
        begun[late] = want[late]
        state = want[late]
        for k in range(length):
            state = a.step[state * a.width + columns[k, late]]
            differ = state != seen[k, late]
            if not differ.any():
                break
            late, state = late[differ], state[differ]
            seen[k, late] = state
    return seen.T.ravel()[:n][::-1]


def match_at(data: bytes, start: int, k: int, compiled: Compiled) -> tuple[int, int]:
    """End of rule k's longest match at ``start`` and the place of its value."""
    state, end, value = 0, start, start
    lead, whole = 1 << 2 * k, 2 << 2 * k
    step, tags, a = compiled.step, compiled.tags, compiled.anchored
    width, classes, dead = a.width, a.byte_class, a.dead
    for at in range(start, len(data)):
        state = step[state * width + classes[data[at]]]
        if state == dead:
            break
        tag = tags[state]
        if tag & lead:
            value = at + 1
        if tag & whole:
            end = at + 1
    return end, value


def find_secrets(data: bytes, compiled: Compiled) -> list[tuple[int, int, int]]:
    """``(start, end, rule)`` of the matches that count, in bytes, by start and rule.

    ``data`` may hold several texts with ``BORDER`` between them.
    """
    if not data:
        return []
    tags = compiled.mirrored.tags[states_backwards(data, compiled.mirrored)]
    spots = np.flatnonzero(tags)
    marks = tags[spots]
    out = []
    for k, rule in enumerate(compiled.rules):
        reach = 0
        starts = spots[(marks >> k) & 1 == 1]
        at = 0
        while at < len(starts):
            start = int(starts[at])
            end, value = match_at(data, start, k, compiled)
            if end - value >= rule.least:
                out.append((start, end, k))
            reach = end
            at = int(np.searchsorted(starts, reach))
    return sorted(out, key=lambda x: (x[0], x[2]))


COUNTS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
LISTS = "found array<struct<kind:string,start:long,end:long,value:string>>"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, lists: bool = True) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text): one row per row.

    ``n_*`` count the base rules' spans, ``spans`` joins ``kind:start:end`` of
    all rules by start and then rule order (code points, end exclusive),
    ``base_sha256`` is the digest of the base rules' part of it, and ``found``
    lists the spans with their text (left out with ``lists=False``). Null and
    empty texts have no span and the digest of the empty string; repeated rows
    each give a row; other columns are ignored. A map over rows, no shuffle; the
    automata have a size that the rules alone decide.
    """
    compiled = compile_rules(rules)
    base = {r.kind for r in BASE}

    def run(batch: pa.RecordBatch):
        data = texts(batch)
        joined = BORDER.join(data)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in data])))
        spans: list[list] = [[] for _ in data]
        found = find_secrets(joined, compiled)
        for s, e, k in found:
            row = int(np.searchsorted(starts, s, "right")) - 1
            spans[row].append((s - int(starts[row]), e - int(starts[row]), compiled.rules[k].kind))
        cols: dict = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")}
        for text, own in zip(data, spans):
            if own and not text.isascii():  # bytes to code points
                points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                listed = [(kind, int(points[s]), int(points[e]), text[s:e]) for s, e, kind in own]
            else:
                listed = [(kind, s, e, text[s:e]) for s, e, kind in own]
            names = [f"{kind}:{s}:{e}" for kind, s, e, _ in listed]
            for kind in ("assign", "access", "hex"):
                cols[f"n_{kind}"].append(sum(x[0] == kind for x in listed))
            own_base = ",".join(x for x, y in zip(names, listed) if y[0] in base)
            cols["base_sha256"].append(hashlib.sha256(own_base.encode()).hexdigest())
            cols["spans"].append(",".join(names))
            cols["found"].append([{"kind": a, "start": b, "end": c, "value": d.decode()} for a, b, c, d in listed])
        yield {"doc_id": batch.column("doc_id"), **cols}

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run,
                     f"doc_id long, {COUNTS}" + (f", {LISTS}" if lists else ""))
