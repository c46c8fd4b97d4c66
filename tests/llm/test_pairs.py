"""Near duplicates, decontamination and the pipeline against plain versions."""

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
import pytest
from weft.llm import decontaminate, minhash, queries, secrets
from weft.llm.common import Scratch, hot_keys, salted_join, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near(text, words):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < words else zip(*(w[k:] for k in range(words))) if w else ())


def groups(rows, words):
    """For each row its set's size and the rows of its component."""
    sets, top = [near(t, words) for _, t in rows], list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and (sets[a] == sets[b] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    by = {}
    for i in range(len(rows)):
        by.setdefault(find(i), []).append(i)
    return [(len(sets[i]), by[find(i)]) for i in range(len(rows))]


def plain(rows, words):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    out = []
    for (i, _), (n, own) in zip(rows, groups(rows, words)):
        ids = [rows[k][0] for k in own if rows[k][0] is not None]
        least = (min(ids) if ids else None) if n else i
        out.append((i, n, least, least is None or i == least))
    return out


def survivors(rows, words):
    """Rows that near_dedup keeps: those without words, and of each component that with the least id, then text key."""
    import hashlib

    out = []
    for k, (n, own) in enumerate(groups(rows, words)):
        order = [(rows[j][0] is None, rows[j][0] or 0, hashlib.md5((rows[j][1] or "").encode()).digest(), j) for j in own]
        if n == 0 or min(order)[3] == k:
            out.append(rows[k])
    return out


@pytest.fixture(scope="module")
def rows(spark, small):
    real = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    draw = random.Random(1)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    copies = []
    for k in range(150):  # one group in which about half of all pairs are linked
        words = list(base)
        for _ in range(draw.randint(3, 9)):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 10**6)}"
        copies.append((10_000 + k, " ".join(words)))
    odd = [(20_000, None), (20_001, ""), (20_002, "  \n"), (20_003, "One"), (20_004, "one"), (20_005, "one two"), (20_006, "ONE\ttwo"), (None, "one"), (None, None), (10_000, copies[0][1])]
    return real + copies + odd


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, rows, words):
    docs = spark.createDataFrame([(i, t, True, 5) for i, t in rows], "doc_id long, text string, kept boolean, label long").repartition(3)
    got = minhash.near_duplicates(docs, words=words).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in got) == Counter(plain(rows, words))
    assert minhash.near_duplicates(docs.limit(0), words=words).collect() == []
    left = minhash.without_near_duplicates(docs, small=0 if words == 2 else 500_000, words=words)
    assert left.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(survivors(rows, words))


def test_near_dedup_tells_documents_apart_by_row(spark):
    a, b, c = "one two three four five six", "red green blue white black brown", "Do re mi fa so la"
    cases = [(1, a), (1, a), (2, a), (3, b), (3, a), (None, b), (None, b), (None, c), (None, c), (None, c.upper()), (4, None), (4, None), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(cases)], "doc_id long, text string, row long")
    for small in (0, 500_000):
        left = minhash.without_near_duplicates(docs, small=small)
        assert left.columns == docs.columns
        assert sorted(((r["doc_id"], (r["text"] or "").lower()) for r in left.collect()), key=str) == sorted([(1, a), (3, b), (None, c.lower()), (4, ""), (4, ""), (None, "")], key=str)
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs).collect()) == Counter(plain(cases, 5))


def test_hot_groups_just_below_the_threshold(spark):
    """Two large groups of near copies and strangers made of both: many pairs of one bucket aren't linked."""
    draw = random.Random(9)
    first, second = ([f"{x}{draw.randint(0, 900)}" for _ in range(60)] for x in "ab")
    cases = []
    for k in range(240):
        words = list(first if k % 3 else second)
        if k % 5 == 0:
            words[: draw.randint(4, 20)] = (second if k % 3 else first)[: draw.randint(4, 20)]
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 40)}"
        cases.append((k, " ".join(words)))
    docs = spark.createDataFrame(cases, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs, words=1).collect()) == Counter(plain(cases, 1))


def test_components(spark):
    draw = random.Random(3)
    edges = [(7, k) for k in range(8, 1400)] + [(draw.randint(2000, 4000), draw.randint(2000, 4000)) for _ in range(900)] + [(5000 + k, 5001 + k) for k in range(40)]
    scratch = Scratch(spark)
    frame = scratch.cut(spark.createDataFrame([(min(e), max(e)) for e in edges if e[0] != e[1]], "a long, b long"))
    one, many = ({r["node"]: r["label"] for r in minhash.components(frame, scratch, n).collect()} for n in (10_000, 0))
    assert one == many and one[1399] == 7 and one[5040] == 5000


def test_salted_join(spark):
    left = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(4000)], "key long, by long")
    right = spark.createDataFrame([(k, -k) for k in range(9)], "key long, value long")
    hot = hot_keys(left, "key", least=100, parts=4)
    assert [r["key"] for r in hot.collect()] == [0] and [r["key"] for r in hot_keys(left.groupBy("key").count(), "key", "count", 100, 4).collect()] == [0]
    expected = left.join(right, "key")
    assert Counter(salted_join(left, right, "key", "by", hot).select(*expected.columns).collect()) == Counter(expected.collect())


def test_signature_is_circulant():
    import numpy as np

    hasher = minhash.CirculantMinHash(4, 3, bits=8)
    elements = np.array([7, 300, 91], np.uint64)
    places = [int(hasher.first[int(e) & 255]) for e in elements]
    order = hasher.shifted[:, 0]
    assert hasher.signature(elements).tolist() == [min(int(order[(p + k) % 256]) for p in places) for k in range(12)]


def test_decontamination(spark):
    items = [(1, "The quick brown fox jumps over the lazy dog near the old river bank today"), (2, "short item"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]
    copy = "intro words here. THE QUICK, brown fox jumps over a lazy dog near the old river bank today! and more"
    texts = [(1, copy), (2, "clean text about nothing"), (3, None), (4, ""), (5, "xx short item yy"), (6, "alpha beta gamma delta words epsilon zeta eta theta iota extra kappa lambda mu"), (7, "the quick brown fox ran"), (8, copy), (8, copy), (None, copy)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in texts], "doc_id long, text string, score double")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (60, 100_000):
        found = decontaminate.contaminated(docs, benchmark, block_bytes=block).collect()
        got = {(r["doc_id"], r["item_id"]): (r["score"], r["start_word"], r["end_word"]) for r in found}
        assert sorted(((r["doc_id"], r["item_id"]) for r in found), key=str) == sorted([(1, 1), (5, 2), (6, 5), (8, 1), (8, 1), (None, 1)], key=str)
        left = decontaminate.without_contaminated(docs, benchmark, block_bytes=block)
        assert left.schema == docs.schema and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 7]
        assert got[1, 1][1:] == (3, 18) and 0.8 < got[1, 1][0] < 1 and got[5, 2] == (1.0, 1, 3)
    assert decontaminate.contaminated(docs.limit(0), benchmark).collect() == []
    assert decontaminate.contaminated(docs, benchmark.limit(0)).collect() == []


def test_many_edited_copies_beside_an_exact_one(spark):
    item = [f"w{k}x" for k in range(36)]
    edited = [f"changed{k}" if k in (4, 9, 14, 19, 24) else w for k, w in enumerate(item)]
    docs = spark.createDataFrame([(0, " ".join(item)), *((k, f"before {' '.join(edited)} after {k}") for k in range(1, 41)), (99, " ".join(item[30:34]))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {0: 1.0} | {k: round(57 / 72, 6) for k in range(1, 41)}


def test_items_without_an_id_or_with_a_shared_one(spark):
    texts = ["one two three four five six", "red green blue white black brown", "north east south west up down", "do re mi fa sol la"]
    items = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, None)]
    docs = spark.createDataFrame([(k, f"so {t} then") for k, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (1, 100_000):
        got = sorted((r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.contaminated(docs, benchmark, block_bytes=block).collect())
        assert got == [(0, 1, 1.0), (1, 1, 1.0), (2, None, 1.0), (3, None, 1.0)]


def test_documents_are_told_apart_by_row(spark):
    item = "one two three four five six seven"
    rows = [(2, f"b {item} b"), (2, "clean text of two"), (3, "clean text of three"), (None, f"b {item}"), (None, "clean text of none"), (None, f"b {item}"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item), (7, "another item that nobody holds")], "item_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in decontaminate.without_contaminated(docs, benchmark).collect()]
    assert sorted(left, key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)
    assert sorted((r["doc_id"] for r in decontaminate.contaminated(docs, benchmark).collect()), key=str) == [2, None, None]


def test_op9_against_plain_search(spark, small):
    """All hits over sf0.001 and edited copies, against every item aligned to every whole text that shares three words with it."""
    draw = random.Random(5)
    items = [(r["item_id"], decontaminate.words_of(r["text"])) for r in table(spark, small, "benchmark").collect()]
    docs = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    for k, (_, words) in enumerate(items):  # copies with more and more edits: words changed, left out and put in
        for edits in (1, 3, 6, 10, 14):
            w = list(words)
            for _ in range(edits):
                at = draw.randrange(len(w))
                w[at : at + draw.randint(0, 1)] = [f"edit{draw.randint(0, 99)}"] * draw.randint(0, 1)
            docs.append((5000 + 10 * k + edits, f"some words ahead {' '.join(w)} and behind"))
    expected = {}
    for doc_id, text in docs:
        there = decontaminate.words_of(text)
        seeds = {" ".join(there[k : k + 3]) for k in range(len(there) - 2)}
        for item_id, words in items:
            if seeds & set(decontaminate.grams_of(words, 3)):
                score, a, b = decontaminate.alignment(words, there)
                if score >= 0.5:
                    expected[doc_id, item_id] = round(score, 6)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(frame, table(spark, small, "benchmark")).collect()}
    assert len(expected) > 100 and got == expected


def test_alignment_against_the_table():
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.choice(["aaaab", "aaaac", "b", "c", "d"]) for _ in range(draw.randint(1, 9))] for _ in range(2))
        h, top = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], 0.0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                match = 2 if a[i - 1] == b[j - 1] else 1 if a[i - 1][:4] == b[j - 1][:4] else -1
                h[i][j] = max(0, h[i - 1][j - 1] + match, h[i - 1][j] - 1, h[i][j - 1] - 1)
                top = max(top, h[i][j])
        assert decontaminate.alignment(a, b)[0] == top / (2 * len(a)) <= decontaminate.most_possible(a, b)


def test_op9_finds_whole_items(spark):
    folder = "/root/testdata/sf0.01"
    items = {r["item_id"]: " ".join(decontaminate.words_of(r["text"])) for r in table(spark, folder, "benchmark").collect()}
    docs = [(r["doc_id"], f" {' '.join(decontaminate.words_of(r['text']))} ") for r in table(spark, folder, "documents").collect()]
    whole = {(d, i) for d, t in docs for i, x in items.items() if x and f" {x} " in t}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.op9_decontaminate(spark, folder).collect()}
    assert whole and whole <= {k for k, score in got.items() if score == 1}


def test_pipeline(spark, small):
    docs, scratch = table(spark, small, "documents"), Scratch(spark)
    names = docs.columns
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.cut(stage(spark, steps[-1], small))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == names
        steps.append(out)
    rows = [[(r["doc_id"], r["text"]) for r in x.collect()] for x in steps[:5]]
    assert Counter(rows[2]) == Counter(survivors(rows[1], 5))
    leaks = {r["doc_id"] for r in decontaminate.contaminated(steps[2], table(spark, small, "benchmark")).collect()}
    assert {i for i, _ in rows[3]} == {i for i, _ in rows[2]} - leaks
    scanner = secrets.SecretScanner()
    assert dict(rows[4]) == {i: scanner.redact(t.encode()).decode() for i, t in rows[3]}
    assert sorted(r["doc_id"] for r in steps[5].collect()) == sorted(i for i, _ in rows[4])
    assert corpus_pipeline.run(spark, small).count() == len(rows[4])


def test_pipeline_on_odd_rows(spark, small):
    item = next(r["text"] for r in table(spark, small, "benchmark").collect() if len(r["text"].split()) > 8)
    a, b = "A calm text of eight good words here.", "Other words stand in this second calm text."
    odd = [(None, None), (None, a), (None, a), (None, item), (1, None), (1, b), (1, b), (1, a), (2, ""), (2, ""), (3, "a " * 9000), (3, f"so {item}"), (4, "token = abcdef123")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in odd], SCHEMA)
    expected, kept = [], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = Scratch(spark).cut(stage(spark, kept, small))
        if name == "toxicity":
            field = queries.toxic_field(spark, docs, small)
            expected = [r for r, score in zip(odd, field.scores([t or "" for _, t in odd])[0]) if score < 0.7]
        elif name == "near_dedup":
            expected = survivors(expected, 5)
        elif name == "decontamination":
            expected = [r for r in expected if item not in (r[1] or "")]
        elif name == "secret_redaction":
            expected = [(i, (t or "").replace("token = abcdef123", "[ASSIGN]") if t is not None else None) for i, t in expected]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
            assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(expected)
        else:
            assert Counter((r["doc_id"], r["decoded"]) for r in kept.collect()) == Counter((i, t or "") for i, t in expected)
    assert len(expected) >= 8
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0
