"""Secret scans: one deterministic automaton for all rules, in transition arrays, with counters for long runs.

Each rule is a regular expression over bytes. The reversed expressions of all rules, each after any
bytes, are compiled together: Thompson's construction, subset construction, then minimisation by
refining classes of states. One pass over a text's bytes, from its end, steps through that automaton's
array and marks each place where a rule's match begins, for all rules at once.

A counted run, as in AKIA[A-Z0-9]{16,}, that comes after a literal head stands in the automaton as a run of one
or more: the product of all rules' counters would make millions of states. Its length is checked by a
counter beside the automaton, a table of where each set's runs end, made once for a text and set. So every place that
is marked is judged in logarithmic time, whatever follows, and a text in time in proportion to its length.
A rule with such runs must be a sequence of sets and of runs that end where their set's bytes end
(checked when it is compiled); the end of its match is then the only one there is. The other rules' own small automata
walk forward from a marked place over the match itself, to its longest end. Matches are taken leftmost first and don't
overlap within a rule. (For these rules the longest match is also the one that greedy matching finds.)

A rule can ask for a least length of the match or of its last part; matches that fail it are dropped
after they have used up their text.

Defined results: null or empty texts have no spans; offsets count code points, the end exclusive; spans
that begin together are in the order of the rules. Rows that repeat give repeated results, null ids stay null, an
empty table gives an empty result. Columns other than id and text aren't read; redact_secrets() keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow


@dataclass(frozen=True)
class Rule:
    """A regular expression of literals, sets, groups, |, ?, *, + and {n,}; bytes only."""

    kind: str
    pattern: str
    least: int = 0  # characters of the match, without what `lead` matches
    lead: str = ""  # a pattern that stands before what counts, a part of `pattern`


ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?"
# The kinds that the contract asks for, in its order.
BASE_RULES = (
    Rule("assign", ASSIGN + "[A-Za-z0-9+/_.=-]+", 6, ASSIGN),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
# Public formats of further secrets.
MORE_RULES = (
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
)


class Nfa:
    """Thompson's construction over syntax trees; empty moves and moves on sets of bytes."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Add a tree from `start`; gives its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                fresh = self.state()
                self.empty[start].append(fresh)
                start = self.add(part, fresh)
            return start
        end = self.state()
        if kind == "or":
            for part in tree[1]:
                fresh = self.state()
                self.empty[start].append(fresh)
                self.empty[self.add(part, fresh)].append(end)
            return end
        fresh = self.state()  # "star"
        self.empty[start] += [fresh, end]
        self.empty[self.add(tree[1], fresh)] += [fresh, end] if kind == "star" else [end]
        return end

    def closed(self, states) -> frozenset[int]:
        seen, rest = set(states), list(states)
        while rest:
            for x in self.empty[rest.pop()]:
                if x not in seen:
                    seen.add(x)
                    rest.append(x)
        return frozenset(seen)


def parse(pattern: str):
    """A pattern's syntax tree: ("set", bytes), ("cat", trees), ("or", trees), ("star" or "opt", tree)."""
    at = 0

    def escaped() -> int:
        nonlocal at
        if pattern[at] != "\\":
            at += 1
            return ord(pattern[at - 1])
        if pattern[at + 1] == "x":
            at += 4
            return int(pattern[at - 2 : at], 16)
        at += 2
        return ord(pattern[at - 1])

    def one_set() -> frozenset[int]:
        nonlocal at
        out: set[int] = set()
        while pattern[at] != "]":
            low = escaped()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                out |= set(range(low, escaped() + 1))
            else:
                out.add(low)
        at += 1
        return frozenset(out)

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            if pattern[at] == "(":
                at += 1
                tree = choice()
                at += 1
            elif pattern[at] == "[":
                at += 1
                tree = ("set", one_set())
            else:
                tree = ("set", frozenset([escaped()]))
            if at < len(pattern) and pattern[at] in "?*+{":
                mark = pattern[at]
                at += 1
                if mark == "?":
                    tree = ("opt", tree)
                elif mark == "*":
                    tree = ("star", tree)
                elif mark == "+":
                    tree = ("cat", [tree, ("star", tree)])
                else:
                    close = pattern.index("}", at)
                    n = int(pattern[at:close].rstrip(","))
                    tree = ("cat", [tree] * n + [("star", tree)] * pattern[at:close].endswith(","))
                    at = close + 1
            parts.append(tree)
        return ("cat", parts)

    def choice():
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("or", options)

    return choice()


def reverse(tree):
    if tree[0] == "set":
        return tree
    if tree[0] in ("star", "opt"):
        return (tree[0], reverse(tree[1]))
    parts = [reverse(x) for x in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


@dataclass
class Table:
    """A minimal automaton. States are numbered times the number of byte classes, those that accept
    last: a step is `moves[state + classes[byte]]`, and a state from `accepting` on has `rules`."""

    classes: bytes
    moves: list[int]
    start: int
    accepting: int
    rules: dict[int, tuple[int, ...]]
    dead: int


def compile_table(trees, anywhere: bool) -> Table:
    """Subset construction over all trees at once, then minimisation. anywhere: after any bytes."""
    nfa, finals = Nfa(), {}
    root = nfa.state()
    for number, tree in enumerate(trees):
        start = nfa.state()
        nfa.empty[root].append(start)
        finals[nfa.add(tree, start)] = number
    sets = {m[0] for m in nfa.moves if m}
    kinds: dict[tuple[bool, ...], int] = {}
    ordered = sorted(sets, key=sorted)
    classes = bytes(kinds.setdefault(tuple(b in s for s in ordered), len(kinds)) for b in range(256))
    sample = [classes.index(c) for c in range(len(kinds))]
    begin = nfa.closed([root])
    number, table, rest = {begin: 0}, [], [begin]
    while rest:  # breadth first
        fresh = []
        for subset in rest:
            row = []
            for byte in sample:
                to = {nfa.moves[x][1] for x in subset if nfa.moves[x] and byte in nfa.moves[x][0]}
                after = nfa.closed(to | {root} if anywhere else to)
                if after not in number:
                    number[after] = len(number)
                    fresh.append(after)
                row.append(number[after])
            table.append(row)
        rest = fresh
    marks = [tuple(sorted(finals[x] for x in subset if x in finals)) for subset in number]
    group, count = [0] * len(table), 0
    keys: dict = {}
    for x, mark in enumerate(marks):
        group[x] = keys.setdefault(mark, len(keys))
    while len(keys) != count:  # states stay together while their groups and their successors' groups are the same
        count, keys, before = len(keys), {}, group
        group = [keys.setdefault((before[x], *(before[y] for y in row)), len(keys)) for x, row in enumerate(table)]
    member = {}
    for x, g in enumerate(group):
        member.setdefault(g, x)
    order = sorted(member, key=lambda g: (bool(marks[member[g]]), g))
    place, width = {g: i * len(kinds) for i, g in enumerate(order)}, len(kinds)
    moves = [place[group[y]] for g in order for y in table[member[g]]]
    rules = {place[g]: marks[member[g]] for g in order if marks[member[g]]}
    dead = next((place[g] for g in order if not marks[member[g]] and all(group[y] == g for y in table[member[g]])), -1)
    return Table(classes, moves, place[group[0]], min(rules, default=len(moves) + width), rules, dead)


def counted(pattern: str) -> list[tuple[str, frozenset[int], int]] | None:
    """The parts of a rule with counted runs behind a head: ("one", set, 1) for a byte, ("run", set, n) for n or more of a set. None for
    other rules. ValueError where a run's end isn't the end of its set's bytes."""
    tree, parts = parse(pattern), []
    for part in tree[1] if tree[0] == "cat" else [tree]:
        if part[0] == "set":
            parts.append(("one", part[1], 1))
        elif part[0] == "cat" and all(x == part[1][0] for x in part[1][:-1]) and part[1][0][0] == "set" and part[1][-1] == ("star", part[1][0]):
            parts.append(("run", part[1][0][1], len(part[1]) - 1))
        else:
            return None
    if parts[0][0] == "run" or all(n == 1 for _, _, n in parts):
        return None
    if any(kind == "run" and own & after for (kind, own, _), (_, after, _) in zip(parts, parts[1:])):
        raise ValueError(f"a counted run must end where its bytes end: {pattern}")
    return parts


def relaxed(parts: list[tuple[str, frozenset[int], int]]):
    """The tree of a rule whose counted runs are of one or more."""
    return ("cat", [("set", own) if kind == "one" else ("cat", [("set", own), ("star", ("set", own))]) for kind, own, _ in parts])


class RunEnds:
    """Where the runs of sets of bytes end in one text."""

    def __init__(self, text: bytes):
        self.text, self.breaks = np.frombuffer(text, np.uint8), {}

    def after(self, own: frozenset[int], at: int) -> int:
        """The first place from `at` on whose byte isn't in the set."""
        if own not in self.breaks:
            other = np.ones(256, bool)
            other[list(own)] = False
            self.breaks[own] = np.flatnonzero(other[self.text])
        found = self.breaks[own]
        k = int(np.searchsorted(found, at))
        return int(found[k]) if k < len(found) else len(self.text)


class SecretScanner:
    def __init__(self, rules=BASE_RULES + MORE_RULES):
        self.rules = rules
        trees = [parse(r.pattern) for r in rules]
        self.parts = [counted(r.pattern) for r in rules]
        self.all = compile_table([reverse(relaxed(p) if p else t) for p, t in zip(self.parts, trees)], anywhere=True)
        self.own = [None if p else compile_table([t], anywhere=False) for p, t in zip(self.parts, trees)]
        self.leads = [compile_table([parse(r.lead)], anywhere=False) if r.lead else None for r in rules]

    @staticmethod
    def _longest(table: Table, text: bytes, start: int) -> int:
        """The end of the longest match from `start`, or -1."""
        state, end, moves, classes, accepting, dead = table.start, -1, table.moves, table.classes, table.accepting, table.dead
        for at in range(start, len(text)):
            state = moves[state + classes[text[at]]]
            if state == dead:
                break
            if state >= accepting:
                end = at + 1
        return end

    @staticmethod
    def _by_runs(parts, text: bytes, ends: RunEnds, at: int) -> int:
        """The end of a counted rule's match from `at`, or -1."""
        for kind, own, least in parts:
            if kind == "one":
                if at == len(text) or text[at] not in own:
                    return -1
                at += 1
            else:
                end = ends.after(own, at)
                if end - at < least:
                    return -1
                at = end
        return at

    def scan(self, text: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by start and then rule."""
        table = self.all
        state, moves, accepting, starts, at = table.start, table.moves, table.accepting, [], len(text)
        for c in reversed(text.translate(table.classes)):
            at -= 1
            state = moves[state + c]
            if state >= accepting:
                starts.append((at, state))
        if not starts:
            return []
        found, free, ends = [], [0] * len(self.rules), RunEnds(text)
        for start, state in reversed(starts):
            for rule in table.rules[state]:
                if start >= free[rule]:
                    end = self._by_runs(self.parts[rule], text, ends, start) if self.parts[rule] else self._longest(self.own[rule], text, start)
                    if end < 0:
                        continue  # a run is too short
                    free[rule] = end
                    size = end - (self._longest(self.leads[rule], text, start) if self.leads[rule] else start)
                    if size >= self.rules[rule].least:
                        found.append((rule, start, end))
        return sorted(found, key=lambda x: (x[1], x[0]))

    def spans(self, text: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        found = self.scan(text)
        if not found:
            return []
        points, before, n = {}, 0, 0
        for at in sorted({x for _, a, b in found for x in (a, b)}):
            n += len(text[before:at].decode("utf-8", "replace"))
            points[at], before = n, at
        return [(self.rules[r].kind, points[a], points[b]) for r, a, b in found]

    def redact(self, text: bytes) -> bytes:
        """The text with each span, or run of spans that overlap, replaced by its kind in brackets."""
        out, reach = [], 0
        for rule, start, end in self.scan(text):
            if start >= reach:
                out += [text[reach:start], f"[{self.rules[rule].kind.upper()}]".encode()]
            reach = max(reach, end)
        return b"".join([*out, text[reach:]])


def scan_secrets(documents: DataFrame, scanner: SecretScanner | None = None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start and then rule."""
    scanner = scanner or SecretScanner()

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def each(batch):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(x)] if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

        return each

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_secrets(documents: DataFrame, scanner: SecretScanner | None = None) -> DataFrame:
    """All columns of documents, with secrets in `text` replaced; null texts stay null."""
    scanner = scanner or SecretScanner()
    names = documents.columns

    def make():
        k = names.index("text")

        def each(batch):
            texts = [None if x is None else scanner.redact(x) for x in batch.column(k).cast(pa.binary()).to_pylist()]
            columns = list(batch.columns)
            columns[k] = pa.array(texts, pa.binary()).cast(batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

        return each

    return map_arrow(documents, make, documents.schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """The columns of op10."""
    base = [r.kind for r in BASE_RULES]
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    only_base: Column = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(F.encode(joined(only_base), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
