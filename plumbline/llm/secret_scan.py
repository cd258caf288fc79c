"""Secret scan with one deterministic automaton for all rules.

Every rule is a regular expression.  All rules go into one nondeterministic automaton
that may begin anywhere; subset construction and minimisation turn it into transition
arrays over bytes.  One pass over a text's bytes then tells, for each rule, where matches
can end.  For a place found, two automata of the rule alone give the rest: the one of the
reversed rule leads to the leftmost begin, the anchored one to the longest end.

The automata are built once on the driver from the rules; their size depends on the rules
alone.  They travel with the task.  Texts are scanned whole, in place, without a shuffle.
"""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parser

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared, trim

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``pattern`` is a regular expression over ASCII.  A match counts only if it has ``least``
    bytes.  With ``value``, a byte class, only what follows the first colon or equals sign
    and stands in that class is measured.  Lengths are kept out of the automaton, since
    counters of rules that share characters would multiply its states; only a rule that
    would match nearly everywhere without its length carries it in its pattern.
    """

    kind: str
    pattern: str
    least: int = 1
    value: str | None = None


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(_any_case(k) for k in ("password", "passwd", "secret", "token", "api_?key"))
_VALUE = "A-Za-z0-9+/_.=-"

BASE = (
    Rule("assign", rf"""(?:{_KEYWORD})["']?\x20*[:=]\x20*["']?[{_VALUE}]+""", 8, _VALUE),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{8,}", 32),
)
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)


class _Nfa:
    """States with byte moves and free moves, built from parsed expressions."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, items: Sequence, start: int, backward: bool) -> int:
        """Chain parsed items behind ``start`` and return the end state."""
        for op, arg in reversed(items) if backward else items:
            start = self._one(op, arg, start, backward)
        return start

    def _one(self, op: object, arg: object, start: int, backward: bool) -> int:
        if op in (sre.LITERAL, sre.IN):
            codes = frozenset([arg]) if op is sre.LITERAL else _codes(arg)
            end = self.state()
            self.moves[start].append((codes, end))
            return end
        if op is sre.SUBPATTERN:
            return self.add(arg[3], start, backward)
        if op is sre.BRANCH:
            end = self.state()
            for way in arg[1]:
                self.free[self.add(way, start, backward)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            low, high, items = arg
            for _ in range(low):
                start = self.add(items, start, backward)
            if high is sre.MAXREPEAT:
                loop = self.state()
                self.free[start].append(loop)
                self.free[self.add(items, loop, backward)].append(loop)
                return loop
            end = self.state()
            for _ in range(high - low):
                self.free[start].append(end)
                start = self.add(items, start, backward)
            self.free[start].append(end)
            return end
        raise ValueError(f"not supported in a rule: {op}")

    def closed(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)


def _codes(items: Sequence) -> frozenset[int]:
    out: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(arg)
        elif op is sre.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {op}")
    return frozenset(out)


@dataclass
class Automaton:
    """A minimal deterministic automaton; state 0 is the start.

    ``table[state][byte]`` is the next state, ``accepts[state]`` a bit for every rule that
    ends there.  ``dead`` is the state without a way out, or -1.  States from ``first_accept``
    on accept.
    """

    table: list[list[int]]
    accepts: list[int]
    first_accept: int
    dead: int = -1


def compile_rules(patterns: Sequence[str], anchored: bool, backward: bool = False) -> Automaton:
    """Subset construction over all patterns, then minimisation by refining partitions."""
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for i, pattern in enumerate(patterns):
        ends[nfa.add(list(sre_parser.parse(pattern)), start, backward)] = i
    # Bytes that no rule tells apart share a class.
    marks: dict[int, list[int]] = {b: [] for b in range(256)}
    for i, codes in enumerate({c for moves in nfa.moves for c, _ in moves}):
        for b in codes:
            marks[b].append(i)
    classes: dict[tuple, int] = {}
    of_byte = [classes.setdefault(tuple(marks[b]), len(classes)) for b in range(256)]
    sample = {c: of_byte.index(c) for c in classes.values()}
    first = nfa.closed({start})
    ids, rows, todo = {first: 0}, [], [first]
    while todo:
        subset, row = todo.pop(0), []
        for c in range(len(classes)):
            to = {t for s in subset for codes, t in nfa.moves[s] if sample[c] in codes}
            nxt = nfa.closed(to | (set() if anchored else {start}))
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append(ids[nxt])
        rows.append(row)
    accepts = [sum(1 << i for e, i in ends.items() if e in subset) for subset in ids]
    # Start from the accept sets and split groups until their moves agree.
    group = [sorted(set(accepts)).index(a) for a in accepts]
    while True:
        seen: dict[tuple, int] = {}
        split = [seen.setdefault((group[s], *[group[t] for t in row]), len(seen))
                 for s, row in enumerate(rows)]
        if len(set(split)) == len(set(group)):
            break
        group = split
    # Number the groups: start first, then those that do not accept, then the rest.
    of_group = {g: s for s, g in reversed(list(enumerate(split)))}
    order = sorted(of_group, key=lambda g: (accepts[of_group[g]] > 0, g != split[0], g))
    number = {g: i for i, g in enumerate(order)}
    table = [[number[split[rows[of_group[g]][of_byte[b]]]] for b in range(256)] for g in order]
    kinds = [accepts[of_group[g]] for g in order]
    dead = next((i for i, row in enumerate(table) if not kinds[i] and set(row) == {i}), -1)
    return Automaton(table, kinds, next((i for i, k in enumerate(kinds) if k), len(kinds)), dead)


class Scanner:
    """All rules, compiled."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = list(rules)
        self.all = compile_rules([r.pattern for r in rules], anchored=False)
        self.back = [compile_rules([r.pattern], anchored=True, backward=True) for r in rules]
        self.ahead = [compile_rules([r.pattern], anchored=True) for r in rules]
        self.values = [r.value and frozenset(_codes(sre_parser.parse(f"[{r.value}]")[0][1])) for r in rules]
        if any(a.accepts[0] for a in self.ahead):
            raise ValueError("a rule matches the empty text")

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes: leftmost, longest, not overlapping per rule, sorted."""
        table, limit, state = self.all.table, self.all.first_accept, 0
        found: dict[int, list[int]] = {}
        for at, byte in enumerate(data):
            state = table[state][byte]
            if state >= limit:
                kinds, rule = self.all.accepts[state], 0
                while kinds:
                    if kinds & 1:
                        found.setdefault(rule, []).append(at)
                    kinds >>= 1
                    rule += 1
        out = []
        for rule, ends in found.items():
            done = at = 0
            while (at := bisect_left(ends, done, at)) < len(ends):
                last = ends[at]
                start = self._start(rule, data, last, done)
                if start < 0:
                    # What ends here begins inside the last match.  Begin anew behind it, once
                    # for all such ends.
                    last = self._next(rule, data, done)
                    if last < 0:
                        break
                    start = self._start(rule, data, last, done)
                done = self._end(rule, data, start)
                if self._counts(rule, data, start, done):
                    out.append((start, rule, done))
        return sorted(out)

    def _next(self, rule: int, data: bytes, low: int) -> int:
        """The first end of a match that begins at ``low`` or behind it, or -1."""
        table, limit, state = self.all.table, self.all.first_accept, 0
        for at in range(low, len(data)):
            state = table[state][data[at]]
            if state >= limit and self.all.accepts[state] >> rule & 1:
                return at
        return -1

    def _start(self, rule: int, data: bytes, last: int, low: int) -> int:
        auto, state, best = self.back[rule], 0, -1
        for at in range(last, low - 1, -1):
            state = auto.table[state][data[at]]
            if state >= auto.first_accept:
                best = at
            elif state == auto.dead:
                break
        return best

    def _end(self, rule: int, data: bytes, start: int) -> int:
        auto, state, best = self.ahead[rule], 0, start
        for at in range(start, len(data)):
            state = auto.table[state][data[at]]
            if state >= auto.first_accept:
                best = at + 1
            elif state == auto.dead:
                break
        return best

    def _counts(self, rule: int, data: bytes, start: int, end: int) -> bool:
        at, codes = start, self.values[rule]
        if codes:
            while data[at] not in b":=":
                at += 1
            at += 1
            while at < end and data[at] not in codes:
                at += 1
        return end - at >= self.rules[rule].least


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _spans(scanner: Scanner, text: str | None) -> list[tuple[int, int, int]]:
    """Spans in code points."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = scanner.spans(data)
    if len(data) == len(text) or not found:
        return found
    return [(len(data[:a].decode("utf-8", "surrogatepass")), k,
             len(data[:b].decode("utf-8", "surrogatepass"))) for a, k, b in found]


def _line(kinds: Sequence[str], spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, base: Sequence[Rule] = BASE, more: Sequence[Rule] = MORE) -> DataFrame:
    """Scan every whole text for all rules.

    Returns doc_id, spans (kind:start:end in code points with the end left out, sorted by
    start and then rule, comma-joined), base_sha256 (of the same line for the base rules
    alone) and n_<kind> for every base rule.  Null and empty texts have no spans.  Repeated
    rows are each returned, null ids too; other columns are not looked at.
    """
    get = shared(docs.sparkSession, compiled((*base, *more)))
    kinds, n = [r.kind for r in (*base, *more)], len(base)
    names = [f"n_{r.kind}" for r in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = get()
        for batch in batches:
            found = [_spans(scanner, t) for t in batch.column("text").to_pylist()]
            kept = [[s for s in spans if s[1] < n] for spans in found]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in kept], pa.int64())
                      for k in range(n)]
            digests = [hashlib.sha256(_line(kinds, s).encode()).hexdigest() for s in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()),
                 pa.array([_line(kinds, s) for s in found], pa.string())],
                ["doc_id", *names, "base_sha256", "spans"])

    counts = ", ".join(f"{name} long" for name in names)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *MORE), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced; spans that overlap are replaced as one."""
    get = shared(docs.sparkSession, compiled(tuple(rules)))

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = get()
        for texts in batches:
            yield pd.Series([_masked(scanner, t, mark) for t in texts], dtype=object)
        trim()

    return docs.withColumn("text", mask("text"))


def _masked(scanner: Scanner, text: str | None, mark: str) -> str | None:
    out, done = [], 0
    for start, _, end in _spans(scanner, text):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text
