"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, in lower case. All n-grams of the test items are looked for in
every whole text, in one pass, by an Aho-Corasick automaton over the text's words. Each hit points to
a place where its item would begin; the words around it (half as many as the item has, on both sides)
are aligned to the item's words: 2 for equal words, 1 for words that share their first four letters, -1
for others and for gaps. The score is the best local alignment's part of the item's own score; at
`least` or more the text holds the item, as a copy or edited. A phrase of the language costs little: a
passage whose words, in any order, can't bring the score to `least` isn't aligned. Every n-gram is a
seed, common ones as well as rare ones: how many copies there are of one passage doesn't decide
whether another is found.

Texts are searched where they lie, row by row: no shuffle, no join, nothing to be gathered for a
group of documents, and no identity of documents but the row itself. The items are a query set: they
come to the driver in blocks of about `block_bytes` bytes (an item is never parted), and each block is
searched in all documents.

Defined results: a row of the result for each row of documents and each item that it holds, so that
rows that repeat, share an id or have none are each searched and give hits of their own. An item is a
distinct (item_id, text): texts that share an id, or whose id is null, are each searched. Items with
fewer than `n` words give one n-gram of their length. Null or empty texts and items match nothing. Of
equally good passages of one item in a text the first one counts. Empty tables give an empty result.
Columns other than id and text are not read; in without_contaminated() they are kept as they are.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id long, item_id long, score double, start_word long, end_word long"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(words: list[str], n: int) -> list[str]:
    n = min(n, len(words))
    return [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if n else []


def most_possible(item: list[str], passage: list[str]) -> float:
    """What no alignment's score is above: each word of the item counts by the best word of the passage."""
    whole, heads = {*passage}, {w[:4] for w in passage}
    return sum(2 if w in whole else w[:4] in heads for w in item) / (2 * max(1, len(item)))


def alignment(item: list[str], passage: list[str]) -> tuple[float, int, int]:
    """Best local alignment's score as a part of the item's own, and its (start, end) in the passage."""
    m, p = len(item), len(passage)
    if not m or not p:
        return 0.0, 0, 0
    codes: dict[str, int] = {}
    number = lambda ws: np.array([codes.setdefault(w, len(codes)) for w in ws])
    a, b, a4, b4 = number(item), number(passage), number("\n" + w[:4] for w in item), number("\n" + w[:4] for w in passage)
    score = np.zeros(p + 1)
    origin = np.arange(p + 1)
    best = (0.0, 0, 0)
    steps = np.arange(p + 1)
    for i in range(m):
        match = np.where(b == a[i], 2.0, np.where(b4 == a4[i], 1.0, -1.0))
        diagonal, up = score[:-1] + match, score[1:] - 1
        fresh = np.concatenate([[0.0], np.maximum(np.maximum(diagonal, up), 0)])
        source = np.concatenate([[0], np.where(diagonal >= up, origin[:-1], origin[1:])])
        source = np.where(fresh <= 0, steps, source)
        # gaps along the passage: the best of what stands to the left, less its distance
        lifted = fresh + steps
        reach = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == reach, steps, 0))
        score, origin = reach - steps, source[at]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (float(score[top]), int(origin[top]), top)
    return best[0] / (2 * m), best[1], best[2]


class ItemSearch:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[list[str]], n: int, least: float):
        self.items, self.least = items, least
        sources: dict[str, list[tuple[int, int, int]]] = {}
        for at, words in enumerate(items):
            for k, gram in enumerate(grams_of(words, n)):
                sources.setdefault(f" {gram} ", []).append((at, k, gram.count(" ") + 1))
        self.automaton = ahocorasick.Automaton()
        for key, found in sources.items():
            self.automaton.add_word(key, found)
        self.any = bool(sources)
        self.automaton.make_automaton()

    def places(self, joined: str) -> dict[tuple[int, int], None]:
        """(item, word where it would begin) of each seed in a text's words, joined by blanks."""
        place, before, met = 0, 0, {}
        for end, found in self.automaton.iter(joined):
            place += joined.count(" ", before, end)  # words that end before this blank
            before = end
            for at, k, size in found:
                met[at, place - size - k] = None
        return met

    def hits(self, text: str | None, only_first: bool = False) -> list[tuple[int, float, int, int]]:
        """(item, score, start, end) of the best passage of each item that the text holds, in words."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        for at, begin in sorted(self.places(f" {' '.join(words)} ")) if words and self.any else ():
            own = self.items[at]
            low = max(0, begin - len(own) // 2)
            passage = words[low : begin + len(own) + len(own) // 2 + 1]
            if most_possible(own, passage) < self.least:
                continue
            score, a, b = alignment(own, passage)
            if score >= self.least and score > best.get(at, (0.0,))[0]:
                best[at] = (score, low + a, low + b)
                if only_first:
                    break
        return [(at, *x) for at, x in best.items()]


def item_blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[int | None, list[str]]]]:
    """The distinct items (item_id, words), in blocks of about so many bytes; blocks are planned where the items lie."""
    scratch = Scratch(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct()
    items = scratch.cut(items.withColumn("number", F.monotonically_increasing_id()))
    part = F.shiftright("number", 33)  # the number's upper bits: the partition that an item was in
    size = F.octet_length("text").cast("long") + 16
    before = F.sum(size).over(Window.partitionBy("part").orderBy("number")) - size
    placed = items.withColumn("part", part).withColumn("before", before)
    parts = placed.groupBy("part").agg(F.sum(size).alias("size"))  # a row for each partition of the items
    parts = parts.select("part", (F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("size")).alias("start"))
    placed = placed.join(F.broadcast(parts), "part").withColumn("block", F.floor((F.col("start") + F.col("before")) / block_bytes))
    out = []
    for block in sorted(r["block"] for r in placed.select("block").distinct().collect()):
        rows = placed.filter(F.col("block") == block).select("item_id", "text", "number").collect()
        out.append([(r["item_id"], words_of(r["text"])) for r in sorted(rows, key=lambda r: r["number"])])
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, block_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, item_id, score, start_word and end_word: the best passage of each item that a row's text holds."""
    out = None
    for block in item_blocks(benchmark, block_bytes):

        def make(block=block):
            search, ids = ItemSearch([words for _, words in block], n, least), [i for i, _ in block]

            def each(batch):
                found = [(doc_id, ids[at], round(score, 6), a, b) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for at, score, a, b in search.hits(text)]
                columns = list(zip(*found)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["doc_id", "item_id", "score", "start_word", "end_word"])

            return each

        found = map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), make, FOUND)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else documents.sparkSession.createDataFrame([], FOUND)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, block_bytes: int = 8_000_000) -> DataFrame:
    """The rows, with all their columns, whose text holds no item."""
    names = documents.columns
    for block in item_blocks(benchmark, block_bytes):

        def make(block=block):
            search, k = ItemSearch([words for _, words in block], n, least), names.index("text")

            def each(batch):
                yield batch.filter(pa.array([not search.hits(text, only_first=True) for text in batch.column(k).to_pylist()], pa.bool_()))

            return each

        documents = map_arrow(documents, make, documents.schema)
    return documents
