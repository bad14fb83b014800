"""Regular expressions of bytes compiled to one transition array.

Thompson construction, subset construction and minimisation by partition
refinement. The supported syntax is what secret rules need: literals, escapes
(``\\.``, ``\\xHH``, ``\\d``), classes, groups, alternation, ``? * +`` and
``{m}``, ``{m,}``, ``{m,n}``; ``(?i)`` in front folds A-Z.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DIGITS = frozenset(range(48, 58))
#: Bytes that UTF-8 uses, and what ``.`` means; negated classes hold bytes of long characters too.
BYTES = frozenset(range(255))
ANY = BYTES - {10}
#: Compilation above this many subset states is refused: the rules are too entangled.
MAX_STATES = 50_000


@dataclass
class Nfa:
    """Moves by byte set and without a byte; built forwards or backwards."""

    moves: list = field(default_factory=list)  # per state: (bytes, target)
    free: list = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1


def parse(pattern: str):
    """Tree of ``("set", bytes)``, ``("cat", parts)``, ``("or", parts)``, ``("rep", part, least, most)``."""
    fold = pattern.startswith("(?i)")
    text, at = pattern.removeprefix("(?i)"), 0

    def one(chars: frozenset) -> tuple:
        if fold:
            chars = chars | {c ^ 32 for c in chars if chr(c).isalpha()}
        return "set", frozenset(chars)

    def escape() -> frozenset:
        nonlocal at
        c = text[at]
        at += 1
        if c == "x":
            at += 2
            return frozenset({int(text[at - 2:at], 16)})
        return DIGITS if c == "d" else frozenset({ord(c)})

    def char_class() -> tuple:
        nonlocal at
        negative = text[at] == "^"
        at += negative
        chars: set = set()
        first = True
        while first or text[at] != "]":
            first = False
            c, at = text[at], at + 1
            low = escape() if c == "\\" else frozenset({ord(c)})
            if text[at] == "-" and text[at + 1] != "]":
                at += 1
                c, at = text[at], at + 1
                high = escape() if c == "\\" else frozenset({ord(c)})
                low = frozenset(range(min(low), max(high) + 1))
            chars |= low
        at += 1
        return one(BYTES - chars if negative else frozenset(chars))

    def atom() -> tuple:
        nonlocal at
        c, at = text[at], at + 1
        if c == "(":
            inner = either()
            if text[at:at + 1] != ")":
                raise ValueError(f"open group in {pattern!r}")
            at += 1
            return inner
        if c == "[":
            return char_class()
        if c == "\\":
            return one(escape())
        return one(ANY if c == "." else frozenset({ord(c)}))

    def repeated() -> tuple:
        nonlocal at
        node = atom()
        while at < len(text) and text[at] in "?*+{":
            c, at = text[at], at + 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, None))
            if c == "{":
                end = text.index("}", at)
                low, comma, high = text[at:end].partition(",")
                least, most = int(low), int(high) if high else None if comma else int(low)
                at = end + 1
            node = ("rep", node, least, most)
        return node

    def sequence() -> tuple:
        parts = []
        while at < len(text) and text[at] not in "|)":
            parts.append(repeated())
        return "cat", parts

    def either() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(text) and text[at] == "|":
            at += 1
            parts.append(sequence())
        return "or", parts

    tree = either()
    if at < len(text):
        raise ValueError(f"stray {text[at]!r} in {pattern!r}")
    return tree


def build(nfa: Nfa, node: tuple, start: int, backwards: bool) -> int:
    """Add ``node`` behind ``start`` (its mirror image if ``backwards``); its last state."""
    kind = node[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[start].append((node[1], end))
        return end
    if kind == "cat":
        for part in node[1][::-1] if backwards else node[1]:
            start = build(nfa, part, start, backwards)
        return start
    if kind == "or":
        end = nfa.state()
        for part in node[1]:
            enter = nfa.state()
            nfa.free[start].append(enter)
            nfa.free[build(nfa, part, enter, backwards)].append(end)
        return end
    _, part, least, most = node
    for _ in range(least):
        start = build(nfa, part, start, backwards)
    if most is None:
        loop = nfa.state()
        nfa.free[start].append(loop)
        nfa.free[build(nfa, part, loop, backwards)].append(loop)
        return loop
    end = nfa.state()
    nfa.free[start].append(end)
    for _ in range(most - least):
        start = build(nfa, part, start, backwards)
        nfa.free[start].append(end)
    return end


@dataclass(frozen=True)
class Automaton:
    """Deterministic: ``step[state * width + byte_class[byte]]`` is the next state,
    ``tags[state]`` has bit k set where pattern k accepts. State 0 is the start;
    ``dead`` is the state that nothing leaves, -1 without one."""

    step: np.ndarray
    byte_class: bytes
    width: int
    tags: np.ndarray
    dead: int


def byte_classes(nfa: Nfa) -> tuple[bytes, list[int]]:
    """Class of each byte (bytes that no move tells apart), and a byte of each class."""
    sets = list({s for moves in nfa.moves for s, _ in moves})
    kinds: dict = {}
    out = bytearray(256)
    for b in range(256):
        key = tuple(b in s for s in sets)
        out[b] = kinds.setdefault(key, len(kinds))
    return bytes(out), [out.index(k) for k in range(len(kinds))]


def compile_patterns(patterns: list[str], backwards: bool = False, anywhere: bool = False) -> Automaton:
    """One automaton for all patterns: forwards or mirrored, from the start or from anywhere."""
    nfa = Nfa()
    root = nfa.state()
    accept: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        enter = nfa.state()
        nfa.free[root].append(enter)
        end = build(nfa, parse(pattern), enter, backwards)
        accept[end] = accept.get(end, 0) | 1 << k
    classes, samples = byte_classes(nfa)

    closures: dict[int, frozenset] = {}

    def closure(state: int) -> frozenset:
        if state not in closures:
            seen, stack = {state}, [state]
            while stack:
                for t in nfa.free[stack.pop()]:
                    if t not in seen:
                        seen.add(t)
                        stack.append(t)
            # only states that move or accept tell subsets apart
            closures[state] = frozenset(s for s in seen if nfa.moves[s] or s in accept)
        return closures[state]

    moves = [[{t for s, t in nfa.moves[x] if b in s} for b in samples] for x in range(len(nfa.moves))]
    first = closure(root)
    number, todo, table = {first: 0}, [first], []
    for subset in todo:
        row = []
        for c in range(len(samples)):
            targets: set = set(first) if anywhere else set()
            for x in subset:
                for t in moves[x][c]:
                    targets |= closure(t)
            key = frozenset(targets)
            if key not in number:
                if len(number) >= MAX_STATES:
                    raise ValueError(f"more than {MAX_STATES} states")
                number[key] = len(number)
                todo.append(key)
            row.append(number[key])
        table.append(row)
    tags = np.zeros(len(todo), np.int64)
    for k, subset in enumerate(todo):
        for x in subset:
            tags[k] |= accept.get(x, 0)
    return minimised(np.array(table, np.int64), tags, classes)


def minimised(table: np.ndarray, tags: np.ndarray, classes: bytes) -> Automaton:
    """Merge states that no input tells apart: refine by tags, then by the blocks moved to."""
    block = np.unique(tags, return_inverse=True)[1]
    n = block.max() + 1
    while True:
        seen = np.concatenate((block[:, None], block[table]), 1)
        block = np.unique(seen, axis=0, return_inverse=True)[1].ravel()
        if block.max() + 1 == n:
            break
        n = block.max() + 1
    # the start's block becomes state 0
    rename = np.arange(n)
    rename[[0, block[0]]] = rename[[block[0], 0]]
    block = rename[block]
    member = np.zeros(n, np.int64)
    member[block] = np.arange(len(block))
    step = block[table[member]]
    stuck = np.flatnonzero((step == np.arange(n)[:, None]).all(1) & (tags[member] == 0))
    dead = int(stuck[0]) if len(stuck) else -1
    return Automaton(step.astype(np.int32).ravel(), classes, step.shape[1], tags[member], dead)
