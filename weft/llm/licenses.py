"""License scans: matching statistics over a generalised suffix automaton of licence tokens.

Every template (a licence notice as words) is a string of one generalised suffix automaton. A text's
words are streamed through it: after each word the automaton's state and length give the longest run
of words, ending there, that stands in any template, and its suffix links the longest in each other template. Runs of
at least `min_match` words that can't be continued in their template are chained, template by template, in the order of
both text and template and with bounded gaps; a chain that covers at least `min_cover` of its template's words is a span
and gives the template's label. Of chains of one label that overlap the one that covers most words is taken.

Base phrases are templates too: one stands wherever a state that has the phrase as a suffix is
reached with at least its length.

Defined results: null or empty texts have no words, no spans and score 0. Rows that repeat give repeated results, null
ids stay null, an empty table gives an empty result; of chains that cover equally much the first one counts. Columns of
the input other than the id and the text are not read. Work grows in proportion to the text.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_WORD, map_arrow

# Phrases that name a licence, with its label.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Sentences of public licence notices, with the label of each.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
)

SCHEMA = "doc_id long, n_words long, base array<struct<label:string,start:long>>, spans array<struct<label:string,start:long,end:long,cover:double>>, score double"


class SuffixAutomaton:
    """Generalised suffix automaton over lists of symbols, built online, one string after another."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.places: list[set[tuple[int, int]]] = [set()]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(dict(moves))
        self.link.append(link)
        self.length.append(length)
        self.places.append(set())
        return len(self.length) - 1

    def _split(self, state: int, target: int, symbol: int) -> int:
        """Part `target` so that the strings reached through `state` have a state of their own."""
        copy = self._state(self.length[state] + 1, self.next[target], self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, number: int, string: list[int]) -> None:
        last = 0
        for end, symbol in enumerate(string, 1):
            if symbol in self.next[last]:
                target = self.next[last][symbol]
                fits = self.length[target] == self.length[last] + 1
                last = target if fits else self._split(last, target, symbol)
            else:
                fresh, walk = self._state(self.length[last] + 1, {}, 0), last
                while walk >= 0 and symbol not in self.next[walk]:
                    self.next[walk][symbol] = fresh
                    walk = self.link[walk]
                if walk >= 0:
                    target = self.next[walk][symbol]
                    fits = self.length[target] == self.length[walk] + 1
                    self.link[fresh] = target if fits else self._split(walk, target, symbol)
                last = fresh
            self.places[last].add((number, end))

    def finish(self) -> None:
        """Give each state the (string, end) of all places where its strings stand."""
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]


class LicenseIndex:
    """The automaton with its vocabulary, and what to do at each state."""

    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES, min_match: int = 3, min_cover: float = 0.6, max_gap: int = 6):
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.labels = [label for _, label in (*phrases, *templates)]
        strings = [ASCII_WORD.findall(text.encode().lower()) for text, _ in (*phrases, *templates)]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in strings for w in s))}
        self.sizes = [len(s) for s in strings]
        self.automaton = SuffixAutomaton()
        for number, string in enumerate(strings):
            self.automaton.add(number, [self.vocabulary[w] for w in string])
        self.automaton.finish()
        # phrases that end where a state is reached: those that are its longest string, and its suffixes' ones
        own = {(p, self.sizes[p]) for p in range(len(phrases))}
        self.ends = [tuple((p, n) for p, n in own & places if n == length) for places, length in zip(self.automaton.places, self.automaton.length)]
        for state in sorted(range(len(self.ends)), key=lambda s: self.automaton.length[s]):
            if state and self.automaton.link[state] > 0:
                self.ends[state] = tuple({*self.ends[state], *self.ends[self.automaton.link[state]]})
        # of each state the templates that have its strings, by the length up to which they have them, and where these end
        self.longest: list[list[tuple[int, int, tuple[int, ...]]]] = [[]]
        for state in range(1, len(self.automaton.length)):
            own, met, walk = [], set(), state
            while walk > 0:
                by: dict[int, list[int]] = {}
                for template, to in sorted(self.automaton.places[walk]):
                    if template >= len(phrases) and template not in met:
                        by.setdefault(template, []).append(to)
                own += [(t, self.automaton.length[walk], tuple(to)) for t, to in by.items()]
                met |= by.keys()
                walk = self.automaton.link[walk]
            self.longest.append(own)

    def scan(self, text: bytes):
        """(words, base places, spans, score) of a text in UTF-8."""
        words = ASCII_WORD.findall(text.lower())
        moves, link, longest, ends = self.automaton.next, self.automaton.link, self.automaton.length, self.ends
        base: list[tuple[str, int]] = []
        segments: dict[int, list[tuple[int, int, int, int]]] = {}
        open_runs: dict[int, tuple[int, int, tuple[int, ...]]] = {}  # of each template: length, end in the text, ends in the template
        state = length = 0
        for at, symbol in enumerate(map(self.vocabulary.get, words)):
            if symbol is None:
                state = length = 0
                continue
            while state and symbol not in moves[state]:
                state = link[state]
                length = longest[state]
            if symbol in moves[state]:
                state = moves[state][symbol]
                length += 1
                for phrase, size in ends[state]:
                    if size <= length:
                        base.append((self.labels[phrase], at + 1 - size))
                if length >= self.min_match:
                    self._extend(open_runs, segments, at + 1, state, length)
        for template, run in open_runs.items():
            self._close(segments, template, *run)
        spans, score = self._chains(segments) if segments else ([], 0.0)
        return len(words), base, spans, score

    def _extend(self, open_runs, segments, end: int, state: int, length: int) -> None:
        """Take in the longest run of each template that ends at a word; what it doesn't continue is closed."""
        for template, size, places in self.longest[state]:
            size = min(size, length)
            if size < self.min_match:
                break
            before = open_runs.get(template)
            if before and not (before[1] == end - 1 and before[0] == size - 1):
                self._close(segments, template, *before)
            open_runs[template] = size, end, places

    @staticmethod
    def _close(segments, template: int, size: int, end: int, places: tuple[int, ...]) -> None:
        segments.setdefault(template, []).extend((end - size, end, to - size, to) for to in places)

    def _chains(self, by_template):
        """Chain runs for each template; the best chain ending at each run covers most template words."""
        found, score = [], 0.0
        for template, segments in by_template.items():
            segments.sort()
            size, best = self.sizes[template], []  # (covered words, start, end in the text, end in the template)
            for start, end, low, high in segments:
                covered, begun = end - start, start
                for words, first, before, reached in reversed(best):
                    if before + 2 * size + self.max_gap < start:
                        break
                    if before <= start <= before + self.max_gap and reached <= low and words + end - start > covered:
                        covered, begun = words + end - start, first
                best.append((covered, begun, end, high))
            for covered, begun, end, _ in best:
                score = max(score, covered / size)
                if covered >= self.min_cover * size:
                    found.append((-covered, begun, end, template))
        spans, taken = [], {}
        for covered, begun, end, template in sorted(found):
            own = taken.setdefault(self.labels[template], [])  # disjoint spans of the label, in order
            k = bisect_left(own, (begun, end))
            if (k == 0 or own[k - 1][1] <= begun) and (k == len(own) or end <= own[k][0]):
                own.insert(k, (begun, end))
                spans.append((self.labels[template], begun, end, -covered / self.sizes[template]))
        return sorted(spans, key=lambda s: (s[1], s[2], s[0])), score


def scan_licenses(documents: DataFrame, index: LicenseIndex | None = None) -> DataFrame:
    """Base places, covered template spans (in words, from 0) and the best template cover of each text."""
    index = index or LicenseIndex()

    def make():
        kinds = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))

        def each(batch):
            found = [index.scan(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([[{"label": a, "start": b} for a, b in x[1]] for x in found], kinds[0]),
                pa.array([[{"label": a, "start": b, "end": c, "cover": d} for a, b, c, d in x[2]] for x in found], kinds[1]),
                pa.array([x[3] for x in found], pa.float64()),
            ], names=["doc_id", "n_words", "base", "spans", "score"])

        return each

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, SCHEMA)


def license_digest(found: DataFrame) -> DataFrame:
    """The columns of op1 from what scan_licenses() returns."""
    starts, joined = F.col("base.start"), lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    return found.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.col("base.label"), F.col("spans.label")).alias("labels"),
        F.greatest(F.col("score"), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
