"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard, components.

A document's set holds the distinct runs of `words` words (A-Z lower-cased, parted by white space) of
its whole text; a text of fewer words has its whole sequence as its one element, and a text without
words an empty set, which is linked with nothing. Two permutations make a signature: the first spreads
the elements' slots over a ring of 2^20 places, the second orders the places; coordinate k is the
least order among the set's places shifted by k, so all coordinates are one circularly shifted second
permutation. Bands of `rows` neighbouring coordinates are hashed to bucket keys. With 64 bands of 8,
a pair of similarity 0.8 shares no bucket with probability 8e-6.

How links are found without pairing whole groups:
1. rows of equal sets form a class at once (by a 128-bit hash of the set), a node of the graph; the number of its first row names it;
2. in each bucket every class is compared with the bucket's smallest, on full sets; components of these links follow;
3. in buckets that still hold several components, a hub of the largest, drawn by hash, is compared with
   one class of each other component, and again while many pairs stand open and each turn closes a tenth
   or more;
4. then all pairs of different components that stand open in a bucket are compared, but those that can't be linked: by the
   number of their elements that stand in other sets of open buckets, or by the bits in which bitmaps of the sets' parities
   differ, as that many elements at least are in one of the two sets only. Both bounds are exact: no test is by chance;
5. components of links are found by least labels with shortcuts (a few links in one task), later ones among
   components instead of classes. Each turn's result is a written table.
Keys that a great part of all rows have (a class of exact copies, a hub, a bucket, an element) are dealt to many tasks.

Defined results: rows are told apart by themselves, not by id. Rows with a null id are linked like others; their
component_id is the smallest id of their component, or null if it has none, and then they count as kept. Rows that
repeat an id each have their own text's component. Null texts are as empty: no set, component_id is the row's own id,
kept. An empty table gives an empty result. Of equal similarity nothing is decided: links are yes or no, and the smallest
id stands for a component. Columns other than id and text are not read; without_near_duplicates() keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components_in_one_task, hot_keys, map_arrow, salted_join, small_enough

U = np.uint64


class Shingler:
    """Sets of hashed word runs."""

    def __init__(self, words: int, most_words: int = 400_000):
        self.words, self.most_words, self.known = words, most_words, {}
        self.factors = np.random.default_rng(11).integers(1, 1 << 63, words + 1, np.int64).astype(U) * U(2) + U(1)

    def _number(self, word: bytes) -> int:
        if len(self.known) >= self.most_words:
            self.known.clear()
        out = self.known[word] = xxhash.xxh64_intdigest(word)
        return out

    def elements(self, text: bytes) -> np.ndarray:
        """The sorted distinct elements of a text's set."""
        words = text.lower().split()
        if not words:
            return np.empty(0, U)
        known = self.known
        h = np.array([known[w] if w in known else self._number(w) for w in words], U)
        k = self.words
        if len(h) < k:
            x = h.copy()
            for j in range(1, len(h)):
                x[:1] = x[:1] * self.factors[-1] + h[j : j + 1]
            return self._mixed(x[:1] + U(len(h)))
        x = h[: len(h) - k + 1] * self.factors[0]
        for j in range(1, k):
            x += h[j : len(h) - k + 1 + j] * self.factors[j]
        return np.unique(self._mixed(x))

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class CirculantMinHash:
    """Signatures from two permutations of 2^bits places, and bucket keys of bands."""

    def __init__(self, bands: int, rows: int, bits: int = 20, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.places = bands, rows, 1 << bits
        self.first = rng.permutation(self.places)
        second = rng.permutation(self.places).astype(np.uint32)
        n = bands * rows
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: n - 1]]), n)
        self.factors = rng.integers(1, 1 << 63, rows, np.int64).astype(U) * U(2) + U(1)
        self.number = np.arange(bands, dtype=U) << U(40)

    def signature(self, elements: np.ndarray) -> np.ndarray:
        places = self.first[(elements & U(self.places - 1)).astype(np.int64)]
        out = self.shifted[places[0]].copy()
        for low in range(0, len(places), 256):
            np.minimum(out, self.shifted[places[low : low + 256]].min(axis=0), out=out)
        return out

    def keys(self, elements: np.ndarray) -> np.ndarray:
        parts = self.signature(elements).astype(U).reshape(self.bands, self.rows)
        return Shingler._mixed((parts * self.factors).sum(axis=1, dtype=U) + self.number).view(np.int64)


def row_key(text: Column) -> Column:
    """16 bytes that tell texts apart."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def signatures(documents: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """A row for each document: its number, doc_id, key of its text, set size, the set's 128-bit hash, and bucket keys."""

    def make():
        shingler, hasher = Shingler(words), CirculantMinHash(bands, rows)

        def each(batch):
            sizes, hashes, keys = [], [], []
            for text in batch.column(2).to_pylist():
                e = shingler.elements(text or b"")
                sizes.append(len(e))
                hashes.append(np.frombuffer(hashlib.blake2b(e.tobytes(), digest_size=16).digest(), np.int64))
                keys.append(hasher.keys(e) if len(e) else np.empty(0, np.int64))
            h = np.array(hashes).reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), list_array(keys)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "h1", "h2", "keys"])

        return each

    texts = documents.select(F.col("doc_id").cast("long"), row_key(F.col("text")).alias("text_key"), F.col("text").cast("binary"))
    return map_arrow(texts, make, "doc_id long, text_key binary, n_shingles long, h1 long, h2 long, keys array<long>").withColumn("row", F.monotonically_increasing_id())


def list_array(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))


def element_sets(texts: DataFrame, words: int) -> DataFrame:
    """node and its whole set of hashed elements, of rows (node, text)."""

    def make():
        shingler = Shingler(words)

        def each(batch):
            sets = [shingler.elements(x or b"").view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(sets)], names=["node", "elements"])

        return each

    return map_arrow(texts.select("node", F.col("text").cast("binary")), make, "node long, elements array<long>")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of written pairs (a, b), those whose sets have 100 * intersection >= percent * union. A hub has very many pairs."""
    left, right = sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b"))
    small, large = F.least(F.size("set_a"), F.size("set_b")), F.greatest(F.size("set_a"), F.size("set_b"))
    met = salted_join(salted_join(pairs, left, "a", "b", hot_keys(pairs, "a")), right, "b", "a", hot_keys(pairs, "b")).filter(100 * small >= percent * large)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


BITMAP = 4096  # bits


def bitmaps(sets: DataFrame) -> DataFrame:
    """node and 4096 bits in 64 longs, each the parity of the number of elements that are hashed to it. Bits in which two sets
    differ are at most as many as elements that only one of them has."""

    def make():
        def each(batch):
            out = []
            for e in batch.column(1).to_pylist():
                bits = np.bincount((Shingler._mixed(np.array(e, np.int64).view(U)) % U(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
                out.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(out)], names=["node", "bitmap"])

        return each

    return map_arrow(sets.select("node", "elements"), make, "node long, bitmap array<long>")


def open_pairs(sets: DataFrame, reps: DataFrame, placed: DataFrame, mixed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of different components in the open buckets `mixed` that can be linked: neither what elements
    no other of these nodes has, nor in how many bits their bitmaps differ rules it out. Both bounds are exact. A pair is met in
    the first bucket that it has in common, and members of a bucket's largest component only by others."""
    some = scratch.cut(salted_join(placed, mixed.select("key", "hub_label"), "key", "node", hot_keys(mixed, "key", "n")))
    own = sets.join(some.select("node").distinct(), "node").select("node", "elements")
    alone = own.select("node", F.explode("elements").alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    sized = own.select("node", F.size("elements").alias("size")).join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))
    of = scratch.cut(sized.join(bitmaps(own), "node").join(reps.select("node", "keys"), "node"))
    some = scratch.cut(some.join(of, "node"))
    side = lambda end: some.select("key", *(F.col(c).alias(f"{c}_{end}") for c in some.columns if c != "key"))
    met = salted_join(side("b"), side("a").filter("label_a <> hub_label_a"), "key", "node_b", hot_keys(some, "key"))
    only_one = sum((F.bit_count(F.get("bitmap_a", F.lit(k)).bitwiseXOR(F.get("bitmap_b", F.lit(k)))) for k in range(BITMAP // 64)), F.lit(0))
    both = F.least("shared_a", "shared_b", F.floor((F.col("size_a") + F.col("size_b") - only_one) / 2))  # at most
    once = (F.col("label_b") == F.col("hub_label_b")) | (F.col("node_a") < F.col("node_b"))
    first = F.get(F.array_intersect("keys_a", "keys_b"), F.lit(0)) == F.col("key")
    met = met.filter((F.col("label_a") != F.col("label_b")) & once & (100 * both >= percent * (F.col("size_a") + F.col("size_b") - both)) & first)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, in_one_task: int = 200_000) -> DataFrame:
    """(node, label): the least node that each node of the edges (a, b), a written table, reaches. Up to `in_one_task` edges
    are united in a task; more by least labels, turn by turn, with the same result."""
    if edges.count() <= in_one_task:
        return scratch.cut(components_in_one_task(edges))
    both = scratch.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hot = hot_keys(both, "b")
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = salted_join(both, labels.withColumnRenamed("node", "b"), "b", "a", hot).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = labels.join(near, "node").select("node", F.least("label", "near").alias("best"), F.col("label").alias("was"))
        over = labels.select(F.col("node").alias("best"), F.col("label").alias("further"))
        better = scratch.cut(better)
        fresh = scratch.cut(salted_join(better, over, "best", "node", hot_keys(better, "best")).select("node", F.least("best", "further").alias("label"), "was"))
        changed = fresh.filter("label < was").limit(1).count()
        scratch.drop(labels, better)
        labels = fresh.select("node", "label")
        labels._weft_path = fresh._weft_path
        if not changed:
            scratch.drop(both)
            return labels


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after further links (a, b): components of labels instead of nodes."""
    left, right = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a")), labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    met = salted_join(salted_join(links, left, "a", "b", hot_keys(links, "a")), right, "b", "a", hot_keys(links, "b"))
    between = scratch.cut(met.filter("label_a <> label_b").select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct())
    if not between.limit(1).count():
        return labels
    found = components(between, scratch).select(F.col("node").alias("label"), F.col("label").alias("further"))
    changed = salted_join(labels, found, "label", "node", hot_keys(labels, "label")).select("node", F.col("further").alias("label"))
    same = labels.join(found, "label", "left_anti").select("node", "label")
    return scratch.cut(changed.unionByName(same))


def clustered(documents: DataFrame, scratch: Scratch, words: int, percent: int, bands: int, rows: int, small: int) -> DataFrame:
    """doc_id, text_key, n_shingles, and of each row's component (null for rows without a set) the row that stands for it:
    `first`, a struct of its doc_id and text_key, the smallest id before null ones."""
    signed = scratch.cut(signatures(documents, words, bands, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    rep = F.min(F.struct(F.col("row").alias("node"), "text_key", "keys")).alias("rep")  # rows differ in `row`, so no keys are compared
    classes = scratch.cut(signed.filter("n_shingles > 0").groupBy("h1", "h2").agg(rep, F.count("*").alias("n"), first).select("h1", "h2", "n", "first", "rep.*"))
    reps = classes.select("node", "text_key", "keys")
    entries = reps.select("node", F.explode("keys").alias("key"))
    buckets = scratch.cut(entries.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    members = scratch.cut(salted_join(entries, buckets.select("key", "hub"), "key", "node", hot_keys(buckets, "key", "n")))  # of buckets with several classes, the hub itself included
    nodes = scratch.cut(reps.select("node", "text_key").join(members.select("node").distinct(), "node", "left_semi"))
    wanted = nodes.select("node", F.col("text_key").alias("weft_key"))
    texts = documents.select("text").join(F.broadcast(wanted) if small_enough(wanted, small) else wanted, row_key(F.col("text")) == F.col("weft_key"))
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))  # equal texts; copies are dropped before the shuffle
    sets = scratch.cut(element_sets(texts, words))
    tested = scratch.cut(members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    labels = nodes.select("node", F.col("node").alias("label"))
    labels = merged(labels, scratch.cut(linked_pairs(tested, sets, percent)), scratch)
    open_before = None
    for turn in range(1000):  # ends before, as what is open shrinks each time by a tenth at least
        # buckets that still hold several components, how many pairs stand open in them, and a hub of the largest component
        placed = members.select("key", "node").join(labels, "node")
        drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node")).alias("drawn")
        by_label = scratch.cut(placed.groupBy("key", "label").agg(F.count("*").alias("n"), drawn).select("key", "label", "n", F.col("drawn.node").alias("node")))
        hub = F.max(F.struct("n", F.col("label").alias("hub_label"), F.col("node").alias("hub"))).alias("x")
        mixed = by_label.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("labels"), hub).filter("labels > 1 and n > 2")
        mixed = scratch.cut(mixed.select("key", "n", "labels", ((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("pairs"), "x.hub", "x.hub_label"))
        sums = mixed.agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).first()
        if not sums["n"]:
            break
        last = sums["pairs"] <= sums["n"] / 4 or (open_before is not None and sums["pairs"] > 0.9 * open_before)
        open_before = sums["pairs"]
        if last:  # hubs close few of the pairs that are left: all of them
            fresh = open_pairs(sets, reps, placed, mixed, percent, scratch)
        else:  # the hub against one of each other component
            met = salted_join(by_label.select("key", "label", "node"), mixed.select("key", "hub", "hub_label"), "key", "node", hot_keys(mixed, "key", "labels"))
            fresh = met.filter("label <> hub_label").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        fresh = scratch.cut(fresh.join(tested, ["a", "b"], "left_anti"))
        labels = merged(labels, scratch.cut(linked_pairs(fresh, sets, percent)), scratch)
        if last:
            break
        tested = tested.unionByName(fresh)
    # what stands for each component, brought to its classes and then to their rows
    placed = scratch.cut(classes.drop("text_key", "keys").join(labels, "node", "left").select("h1", "h2", "n", "first", F.coalesce("label", "node").alias("label")))
    best = placed.groupBy("label").agg(F.min("first").alias("best"))
    known = scratch.cut(salted_join(placed, best, "label", "h1", hot_keys(placed, "label")).select("h1", "h2", "n", "best"))
    with_set = signed.filter("n_shingles > 0").select("doc_id", "text_key", "n_shingles", "h1", "h2")
    of = F.struct(F.col("best.doc_id").alias("doc_id"), F.col("best.text_key").alias("text_key")).alias("first")
    # classes that hold a great part of all rows are broadcast; there are fewer than 4096 of these
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(known.filter(F.col("n") > max(1000, total // 4096)).drop("n"))
    names = ("doc_id", "text_key", "n_shingles", of)
    found = with_set.join(hot, ["h1", "h2"]).select(*names).unionByName(with_set.join(hot, ["h1", "h2"], "left_anti").join(known, ["h1", "h2"]).select(*names))
    none = signed.filter("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("struct<doc_id:bigint,text_key:binary>").alias("first"))
    out = scratch.cut(found.unionByName(none))
    scratch.drop_others(out)
    return out


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, bands: int = 64, rows: int = 8, small: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that a chain of links reaches) and kept, for each row."""
    found = clustered(documents, Scratch(documents.sparkSession), words, percent, bands, rows, small)
    component = F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def without_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, bands: int = 64, rows: int = 8, small: int = 500_000) -> DataFrame:
    """All columns of one row of each component: that with the smallest id (null ids last), and of several such rows that with
    the smallest key of its text. Of rows that repeat both id and text one stays; rows without words all stay."""
    scratch = Scratch(documents.sparkSession)
    found = clustered(documents, scratch, words, percent, bands, rows, small).filter("n_shingles > 0")
    own = found.select("doc_id", "text_key", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("stays"))
    own = own.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1")
    marked = scratch.cut(own.select(F.col("doc_id").alias("weft_id"), F.col("text_key").alias("weft_key"), F.col("stays").alias("weft_stays")))
    gone, repeated = marked.filter("not weft_stays"), marked.filter("weft_stays")
    on = documents["doc_id"].cast("long").eqNullSafe(F.col("weft_id")) & (row_key(documents["text"]) == F.col("weft_key"))
    near = F.broadcast if small_enough(marked, small) else (lambda x: x)
    if not repeated.limit(1).count():
        return documents.join(near(gone), on, "left_anti")
    once = documents.join(near(repeated), on).groupBy("weft_id", "weft_key").agg(F.first(F.struct(*(documents[c] for c in documents.columns))).alias("weft_row"))
    return documents.join(near(marked), on, "left_anti").unionByName(once.select("weft_row.*"))
