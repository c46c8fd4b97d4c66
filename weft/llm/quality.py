"""Quality classifier: Bradley-Terry pairwise ranking.

A document of label 1 is preferred to one of label 0. Each such pair's probability is a logistic
function of the difference of two document scores, which are linear in features of the text's form;
the weights minimise the logistic loss over all pairs of a training document of each label (Newton's steps; sums over pairs
are products of matrices). The training documents are a sample that the caller bounds.

The threshold is a score quantile. Of cuts between training documents' scores, those with the fewest errors (at the labels'
own frequencies) give a range of thresholds, and the quantile that the labels ask for: the share of documents below. The
threshold is that quantile of the scores of all documents, held within the range, since labels are a sample
of the documents and their share is known only about. The score given is a logistic function that takes `at` there.

Defined results: null and empty texts have features of zero words and are scored like any other. Rows that repeat
give repeated results, null ids stay null, an empty table gives an empty result; of cuts with equally few
errors all are in the range. Without labels of both kinds nothing can be learned: every score is 0 if all
labels are 0, else 1. Columns other than id and text aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=+\\", b"|", b"!", b"?", b".", b",", b";:'\"()-", b"\n")
_columns = np.zeros((256, len(KINDS)))
for _k, _kind in enumerate(KINDS):
    _columns[list(_kind), _k] = 1


def text_features(text: bytes) -> np.ndarray:
    """Form of a text: length, words, repeats, and shares of kinds of bytes."""
    words = text.split()
    n, size = len(words), len(text)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _columns / max(1, size)
    lines = [x for x in text.split(b"\n") if x.strip()]
    twice = sum(map(eq, words, words[1:])) / max(1, n)
    form = [np.log1p(n), np.log1p(n) ** 2 / 5, len({*words}) / max(1, n), twice, len({*lines}) / max(1, len(lines)), np.log1p(size / max(1, n)), np.log1p(n / max(1, len(lines)))]
    return np.concatenate([form, np.log(shares + 1e-3), [np.sqrt(twice), max(0, shares[0] - 0.3), np.sqrt(shares[2])]])


def pair_steps(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the sum of log sigmoid((good_i - bad_j) . w) over all pairs."""
    p = 1 / (1 + np.exp(np.clip(np.subtract.outer(good @ w, bad @ w), -30, 30)))
    q = p * (1 - p)
    cross = good.T @ q @ bad
    return good.T @ p.sum(1) - bad.T @ p.sum(0), (good.T * q.sum(1)) @ good + (bad.T * q.sum(0)) @ bad - cross - cross.T


@dataclass
class PairwiseRanker:
    """Scores by Bradley-Terry weights; `at` is the score given at the threshold."""

    at: float = 0.3
    ridge: float = 1.0  # for each document of the larger class

    def fit(self, rows: list[tuple[str, int]], counts: dict[int, int]) -> PairwiseRanker:
        y = np.array([label for _, label in rows])
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.constant = None if len(good) and len(bad) else 0.0 if len(bad) else 1.0
        if self.constant is not None:
            return self
        x = np.array([text_features(t.encode()) for t, _ in rows]).reshape(len(rows), -1)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        ridge, w = self.ridge * min(len(good), len(bad)), np.zeros(x.shape[1])
        for _ in range(40):
            gradient, curvature = pair_steps(x[good], x[bad], w)
            step = np.linalg.solve(curvature + ridge * np.eye(len(w)), gradient - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-7:
                break
        self.weights, s = w, x @ w
        total = sum(counts.values())
        share = np.where(y == 1, counts.get(1, 0) / total / len(good), counts.get(0, 0) / total / len(bad))
        order = np.argsort(s, kind="stable")
        below = np.concatenate([[0], np.cumsum(np.where(y[order] == 1, share[order], -share[order]))])  # errors, less those of a threshold below all
        best = np.flatnonzero(below <= below.min() + 1e-12)
        ends = np.concatenate([[s[order[0]] - 1], s[order], [s[order[-1]] + 1]])  # cut k lies between ends k and k + 1
        k = int(best[len(best) // 2])
        self.quantile = float(share[order][:k].sum())
        self.low, self.high = float(ends[best[0]]), float(ends[best[-1] + 1])
        self.threshold = float(ends[k] + ends[k + 1]) / 2
        return self

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Scores before the threshold is known."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return (np.array([text_features(t) for t in texts]).reshape(len(texts), -1) - self.mean) / self.scale @ self.weights

    def within(self, quantile: float | None) -> float:
        """The threshold, from the quantile of all documents' scores. A tenth of the range at either end stays clear of the training documents."""
        clear = (self.high - self.low) / 10
        return self.threshold if quantile is None else min(max(quantile, self.low + clear), self.high - clear)


def score_quality(documents: DataFrame, ranker: PairwiseRanker) -> DataFrame:
    """doc_id and score of each document. The scores are written once, as their quantile comes before the result."""

    def make():
        def each(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.raw([x or b"" for x in batch.column(1).to_pylist()]))], names=["doc_id", "raw"])

        return each

    found = map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, "doc_id long, raw double")
    if ranker.constant is not None:
        return found.withColumnRenamed("raw", "score")
    found = Scratch(documents.sparkSession).cut(found)
    cut = ranker.within(found.agg(F.percentile_approx("raw", ranker.quantile, 100_000)).first()[0])
    return found.select("doc_id", (1 / (1 + F.exp(-(F.col("raw") - cut + math.log(ranker.at / (1 - ranker.at)))))).alias("score"))
