"""Toxicity: a linear-chain conditional random field over words.

Labels mark documents; a word of a toxic training document counts as toxic where one of its features
(the word, or its first letters) stands in so many more toxic than clean training documents that the
likelihood-ratio statistic passes `evidence`. On these labelled words the field is trained: two tags,
weights of a word's own features, of its neighbours, and of the moves between tags, by gradient steps
on the conditional likelihood. A chain is a sentence or line, whole, however long.

The field is fitted on a sample of labelled documents that the caller bounds. Of their chains it takes all that hold a
toxic word and, of the others, `clean_each` for each such chain and `clean_least` more, those with the smallest hashes.

Scoring runs forward and backward over each chain for every word's marginal. A document's score is a
logistic function, fitted on the training documents, of the sum and the largest of its marginals;
words whose marginal is at least one half give the offending offsets (code points, the end exclusive).

Defined results: null and empty texts have no words and get the score of a sum of 0. Rows that repeat give repeated
results, null ids stay null, an empty table gives an empty result. Documents of equal score are treated alike; of cuts with
equally few errors the middle one is taken. Without labels of both kinds nothing can be learned: every score is 1
if all labels are 1, else 0. Columns other than id and text aren't read; without_toxic() keeps them.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

TOKEN = re.compile(r"\w+|[.!?\n]")
STOPS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    """Of a word in lower case."""
    return ["=" + word, *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) > n), "$" + word[-3:]]


def blocks(sizes: np.ndarray, places: int) -> list[tuple[int, int]]:
    """(start, end) of runs of ascending sizes that are alike, of at most so many places when all are as long as the longest."""
    out, low = [], 0
    while low < len(sizes):
        alike = int(np.searchsorted(sizes, sizes[low] * 5 // 4 + 2, side="right"))
        high = min(alike, low + max(1, places // max(1, int(sizes[alike - 1]))))
        out.append((low, high))
        low = high
    return out


class ToxicField:
    """The trained field; scores texts. Weights are held by hashed feature."""

    def __init__(self, bits: int = 18, evidence: float = 20.0, steps: int = 30, ridge: float = 0.15, at: float = 0.7, clean_each: int = 3, clean_least: int = 500, most_words: int = 300_000):
        self.bits, self.evidence, self.steps, self.ridge, self.at = bits, evidence, steps, ridge, at
        self.clean_each, self.clean_least, self.most_words = clean_each, clean_least, most_words
        self.size = 1 << bits
        self.own, self.near = np.zeros(self.size), np.zeros((2, self.size))
        self.bias, self.moves = -4.0, np.zeros(3)  # clean to toxic, toxic to clean, toxic to toxic; clean to clean is 0
        self.curve = np.array([-3.0, 2.0, 1.0])
        self.constant: float | None = None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.parts = np.zeros((1024, 3))

    def __getstate__(self):
        used = np.flatnonzero(self.own), *(np.flatnonzero(x) for x in self.near)
        return {k: v for k, v in self.__dict__.items() if k not in ("own", "near", "known", "parts")} | {"used": [(i, x[i]) for i, x in zip(used, (self.own, *self.near))]}

    def __setstate__(self, state):
        used = state.pop("used")
        self.__dict__ |= state
        self.own, self.near = np.zeros(self.size), np.zeros((2, self.size))
        for (i, x), to in zip(used, (self.own, *self.near)):
            to[i] = x
        self._clear()

    def _hash(self, name: str) -> int:
        return zlib.crc32(name.encode()) & (self.size - 1)

    def _number(self, word: str) -> int:
        """The word's place in `parts`: what it adds to itself, to the next word and to the one before."""
        lower = word.lower()
        own = sum(self.own[self._hash(f)] for f in features(lower))
        h = self._hash("=" + lower)
        k = self.known[word] = len(self.known)
        if k == len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
        self.parts[k] = own, self.near[0, h], self.near[1, h]
        return k

    @staticmethod
    def _chains(words: list[str]) -> list[tuple[int, int]]:
        """(start, end) of the chains among a text's tokens."""
        out, start = [], 0
        for at, word in enumerate(words):
            if word in STOPS:
                if at > start:
                    out.append((start, at))
                start = at + 1
        if len(words) > start:
            out.append((start, len(words)))
        return out

    def _sweep(self, odds: np.ndarray, mask: np.ndarray):
        """Forward and backward log odds of chains, one to a row, padded on the right."""
        if len(odds) <= 8:
            rows = [self._sweep_one(row[:size].tolist()) for row, size in zip(odds, mask.sum(axis=1))]
            out = np.zeros((2, *odds.shape))
            for k, (ahead, back) in enumerate(rows):
                out[0, k, : len(ahead)], out[1, k, : len(back)] = ahead, back
            return out[0], out[1]
        a01, a10, a11 = self.moves
        n = odds.shape[1]
        ahead, back = np.empty_like(odds), np.zeros_like(odds)
        ahead[:, 0] = odds[:, 0]
        for t in range(1, n):
            x = ahead[:, t - 1]
            ahead[:, t] = odds[:, t] + np.logaddexp(a01, a11 + x) - np.logaddexp(0, a10 + x)
        for t in range(n - 2, -1, -1):
            x = odds[:, t + 1] + back[:, t + 1]
            back[:, t] = np.where(mask[:, t + 1], np.logaddexp(a10, a11 + x) - np.logaddexp(0, a01 + x), 0)
        return ahead, back

    def _sweep_one(self, odds: list[float]) -> tuple[list[float], list[float]]:
        """The same of one chain, for few and long ones."""
        a01, a10, a11 = map(float, self.moves)

        def add(a: float, b: float) -> float:
            return max(a, b) + log1p(exp(-abs(a - b)))

        ahead, back = odds[:1], [0.0]
        for x in odds[1:]:
            ahead.append(x + add(a01, a11 + ahead[-1]) - add(0.0, a10 + ahead[-1]))
        for x in reversed(odds[1:]):
            z = x + back[-1]
            back.append(add(a10, a11 + z) - add(0.0, a01 + z))
        return ahead, back[::-1]

    def fit(self, rows: list[tuple[str, int]], counts: dict[int, int]) -> ToxicField:
        toxic, clean = sum(y for _, y in rows), sum(1 - y for _, y in rows)
        self.constant = None if toxic and clean else 1.0 if toxic else 0.0
        if self.constant is not None:
            return self
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for text, y in sorted(rows, key=lambda r: -r[1]):  # of clean documents only what toxic ones have, too
            own = {f for w in {w.lower() for w in TOKEN.findall(text)} - STOPS for f in features(w)[:-1]}
            seen[y].update(own if y else own & seen[1].keys())
        share, marks = toxic / (toxic + clean), set()
        for f, a in seen[1].items():
            b = seen[0][f]
            n, rate = a + b, a / (a + b)
            if rate > share and a >= 4 and b <= 0.1 * a * clean / toxic:
                g = 2 * (a * np.log(rate / share) + (b * np.log((1 - rate) / (1 - share)) if b else 0))
                if g >= self.evidence:
                    marks.add(f)
        del seen
        marked: list[tuple[int, int, int]] = []  # (document, start, end) of chains with a toxic word
        spare: list[tuple[int, int, int, int]] = []  # (hash, document, start, end) of others
        for k, (text, y) in enumerate(rows):
            words = [w.lower() for w in TOKEN.findall(text)]
            for a, b in self._chains(words):
                if y and any(f in marks for w in words[a:b] for f in features(w)[:-1]):
                    marked.append((k, a, b))
                else:
                    spare.append((zlib.crc32(" ".join(words[a:b]).encode()), k, a, b))
        wanted = self.clean_each * len(marked) + self.clean_least
        spare = [x[1:] for x in sorted(spare)[:wanted]]
        chains, tags, of, words = [], [], -1, []
        for k, a, b in [*marked, *sorted(spare)]:
            if k != of:
                of, words = k, [w.lower() for w in TOKEN.findall(rows[k][0])]
            chains.append(words[a:b])
            tags.append([int(rows[k][1] and any(f in marks for f in features(w)[:-1])) for w in words[a:b]])
        self._train(chains, tags)
        self._clear()
        sums = np.concatenate([self._sums([text for text, _ in rows[k : k + 200]])[0] for k in range(0, len(rows), 200)])
        y = np.array([y for _, y in rows], float)
        total = sum(counts.values())
        weight = np.where(y == 1, counts.get(1, toxic) / total / toxic, counts.get(0, clean) / total / clean) * len(rows)
        self.curve = logistic(self._shape(sums), y, weight, 1.0)
        logit = self._shape(sums) @ self.curve
        order = np.argsort(logit, kind="stable")
        errors = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, -weight)[order])])  # of each cut, less those of the lowest
        best = np.flatnonzero(errors <= errors.min() + 1e-9)
        k = int(best[len(best) // 2])
        if 0 < k < len(rows):  # the cut with the fewest errors among training documents gets the score `at`
            self.curve[0] += np.log(self.at / (1 - self.at)) - (logit[order[k - 1]] + logit[order[k]]) / 2
        return self

    def _packed(self, chains: list[list[str]], tags: list[list[int]]):
        """Chains of similar length in blocks of at most a million places: (mask, tags, places, features, words)."""
        cache: dict[str, list[int]] = {}
        order = sorted(range(len(chains)), key=lambda i: (len(chains[i]), i))
        out = []
        for low, high in blocks(np.array([len(chains[i]) for i in order], np.int64), 1_000_000):
            n, m = high - low, len(chains[order[high - 1]])
            mask, y, word = np.zeros((n, m), bool), np.zeros((n, m), np.int8), np.full((n, m), -1)
            place, feature = array("q"), array("q")
            for i, k in enumerate(order[low:high]):
                chain = chains[k]
                mask[i, : len(chain)], y[i, : len(chain)] = True, tags[k]
                for t, w in enumerate(chain):
                    ids = cache.get(w) or cache.setdefault(w, [self._hash(f) for f in features(w)])
                    word[i, t] = ids[0]
                    feature.extend(ids)
                    place.extend([i * m + t] * len(ids))
            out.append((mask, y, np.frombuffer(place, np.int64), np.frombuffer(feature, np.int64), word))
        return out

    def gradient(self, theta: np.ndarray, packed) -> np.ndarray:
        """Of the conditional log likelihood of the tags: weights of features, of words before and after, bias and moves."""
        size = self.size
        own, n0, n1, bias, self.moves = theta[:size], theta[size : 2 * size], theta[2 * size : 3 * size], theta[-4], theta[-3:]
        g = np.zeros(len(theta))
        for mask, y, place, feature, word in packed:
            n, m = mask.shape
            pairs = mask[:, 1:]
            before, after = word[:, :-1][pairs], word[:, 1:][pairs]
            odds = np.bincount(place, own[feature], n * m).reshape(n, m) + bias
            odds[:, 1:][pairs] += n0[before]
            odds[:, :-1][pairs] += n1[after]
            ahead, back = self._sweep(odds, mask)
            d = np.where(mask, y - 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40))), 0)
            x, z = ahead[:, :-1], odds[:, 1:] + back[:, 1:]
            logs = np.stack([np.zeros_like(x), z + self.moves[0], x + self.moves[1], x + z + self.moves[2]])
            joint = np.exp(logs - np.logaddexp.reduce(logs, 0))
            move = [((y[:, :-1] == s) & (y[:, 1:] == e))[pairs].sum() - joint[2 * s + e][pairs].sum() for s, e in ((0, 1), (1, 0), (1, 1))]
            g[:size] += np.bincount(feature, d.ravel()[place], size)
            g[size : 2 * size] += np.bincount(before, d[:, 1:][pairs], size)
            g[2 * size : 3 * size] += np.bincount(after, d[:, :-1][pairs], size)
            g[-4] += d.sum()
            g[-3:] += move
        return g

    def _train(self, chains: list[list[str]], tags: list[list[int]]) -> None:
        packed, size, speed, first, second = self._packed(chains, tags), self.size, 0.3, None, None
        theta = np.concatenate([self.own, *self.near, [self.bias], self.moves])
        for step in range(1, self.steps + 1):
            g = self.gradient(theta, packed) - self.ridge * theta
            first = 0.1 * g if first is None else 0.9 * first + 0.1 * g
            second = 0.01 * g * g if second is None else 0.99 * second + 0.01 * g * g
            theta = theta + speed * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * (g != 0)
        self.own, self.near, self.bias, self.moves = theta[:size].copy(), theta[size : 3 * size].reshape(2, size).copy(), float(theta[-4]), theta[-3:].copy()

    def marginals(self, texts: list[str]):
        """For each text its words' marginals (and 0 for stops), as one array with offsets."""
        if len(self.known) > self.most_words:
            self._clear()
        known, numbers, ends, chains = self.known, [], [0], []
        for text in texts:
            words = TOKEN.findall(text)
            base = ends[-1]
            chains += [(base + a, base + b) for a, b in self._chains(words)]
            got = list(map(known.get, words))
            if None in got:
                got = [self._number(w) if (k := known.get(w)) is None else k for w in words]
            numbers += got
            ends.append(base + len(words))
        out = np.zeros(len(numbers))
        if not chains:
            return out, ends
        parts, numbers = self.parts, np.array(numbers)
        spans = np.array(chains)
        sizes = spans[:, 1] - spans[:, 0]
        order = np.argsort(sizes, kind="stable")
        for low, high in blocks(sizes[order], 500_000):
            some = order[low:high]
            m = int(sizes[some].max())
            at = spans[some, 0][:, None] + np.arange(m)
            mask = np.arange(m) < sizes[some][:, None]
            x = parts[numbers[np.minimum(at, len(numbers) - 1)]] * mask[:, :, None]
            odds = x[:, :, 0] + self.bias
            odds[:, 1:] += x[:, :-1, 1]
            odds[:, :-1] += x[:, 1:, 2]
            ahead, back = self._sweep(odds, mask)
            out[at[mask]] = 1 / (1 + np.exp(-np.clip(ahead + back, -40, 40)))[mask]
        return out, ends

    def _sums(self, texts: list[str]):
        """For each text the sum and the largest of its marginals; the marginals and their offsets."""
        p, ends = self.marginals(texts)
        return np.array([(p[a:b].sum(), p[a:b].max(initial=0)) for a, b in zip(ends, ends[1:])]).reshape(-1, 2), p, ends

    @staticmethod
    def _shape(sums: np.ndarray) -> np.ndarray:
        top = np.clip(sums[:, 1], 1e-4, 1 - 1e-4)
        return np.column_stack([np.ones(len(sums)), np.log1p(sums[:, 0]), np.log(top / (1 - top))])

    def scores(self, texts: list[str]):
        """(score, marginals, offsets among them) of texts."""
        sums, p, ends = self._sums(texts)
        if self.constant is not None:
            return np.full(len(texts), self.constant), 0 * p, ends
        return 1 / (1 + np.exp(-self._shape(sums) @ self.curve)), p, ends

    def spans(self, text: str, p: np.ndarray) -> list[tuple[int, int]]:
        """Offsets of words that are toxic more likely than not."""
        return [m.span() for m, x in zip(TOKEN.finditer(text), p) if x >= 0.5]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(documents: DataFrame, field: ToxicField) -> DataFrame:
    """doc_id, score, and the offsets of toxic words."""

    def make():
        def each(batch):
            for low in range(0, batch.num_rows, 400):
                part = batch.slice(low, 400)
                texts = [x or "" for x in part.column(1).to_pylist()]
                score, p, ends = field.scores(texts)
                toxic = [field.spans(t, p[a:b]) if (p[a:b] >= 0.5).any() else [] for t, a, b in zip(texts, ends, ends[1:])]
                spans = pa.array([[{"start": a, "end": b} for a, b in x] for x in toxic], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), spans], names=["doc_id", "score", "spans"])

        return each

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double, spans array<struct<start:long,end:long>>")


def without_toxic(documents: DataFrame, field: ToxicField, most: float) -> DataFrame:
    """The rows, with all their columns, whose score is below `most`."""
    names = documents.columns

    def make():
        k = names.index("text")

        def each(batch):
            for low in range(0, batch.num_rows, 400):
                part = batch.slice(low, 400)
                score, _, _ = field.scores([x or "" for x in part.column(k).to_pylist()])
                yield part.filter(pa.array(score < most))

        return each

    return map_arrow(documents, make, documents.schema)
