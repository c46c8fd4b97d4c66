"""Minimum spanning trees of all pairs whose lengths carry hashed noise, without a table of the pairs: what can't be in a tree isn't drawn."""

from __future__ import annotations

import numpy as np

from ..functions.hashing import pair_draws

LEAST = 1e-12  # of a weight
WIDEST = 6.67  # more than a normal number from 32 bits can be


def lengths(x: np.ndarray, rows: slice) -> np.ndarray:
    """Distances of some points from all that begin with the first of them."""
    total = 0.0
    for k in range(x.shape[1]):
        v = x[rows, k][:, None] - x[rows.start :, k][None]
        total = total + v * v
    return np.sqrt(total)


def _blocks(n: int, first: int = 1_000_000, most: int = 1_000_000):
    """Slices of rows, each with up to so many pairs to all points; the first ones are smaller, if asked for."""
    s, pairs = 0, first
    while s < n:
        e = min(n, s + max(1, pairs // n))
        yield slice(s, e)
        s, pairs = e, min(most, 2 * pairs)


def mean_length(x: np.ndarray) -> float:
    """Of ordered pairs, a point with itself included."""
    n = len(x)
    return 2 * sum(float(np.triu(lengths(x, rows), 1).sum()) for rows in _blocks(n)) / (n * n)


class _Noisy:
    """Weights of pairs in one turn: base, more by `penalty` for each tree that has the pair, and noise; LEAST at least."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, used: dict, penalty: float, noise: float, seed: int):
        text = ids.astype("S21")
        self.size, self.texts = np.char.str_len(text), text.view(np.uint8).reshape(len(ids), 21)
        self.x, self.penalty, self.noise, self.before = x, penalty, noise, f"{seed}:".encode()
        self.wide = abs(noise) / 2**0.5
        keys = np.array([a * len(ids) + b for a, b in used], np.int64)
        order = np.argsort(keys)
        self.keys, self.times = keys[order], np.array([*used.values()], float)[order]

    def _uniform(self, a, b, after=b""):
        return pair_draws(self.before, self.texts, self.size, a, b, after).astype(float) / 4294967296.0

    def upto(self, a: np.ndarray, b: np.ndarray, base: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, weight) of the pairs whose weight is `most` at most; rows a < b."""
        if len(self.keys):
            key = a * len(self.x) + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            base = base * (1 + self.penalty * np.where(self.keys[at] == key, self.times[at], 0))
        if self.noise:
            slack = 1e-9 * (base + self.wide)
            kept = base - WIDEST * self.wide - slack <= most
            a, b, base, slack = a[kept], b[kept], base[kept], slack[kept]
            far = np.sqrt(-2 * np.log(1 - self._uniform(a, b)))
            kept = base - far * self.wide - slack <= most
            a, b, base, far = a[kept], b[kept], base[kept], far[kept]
            drawn = far * np.cos(2 * np.pi * self._uniform(a, b, b":turn"))
            base = np.maximum(base + self.noise * drawn / 2**0.5, LEAST)
        kept = base <= most
        return a[kept], b[kept], base[kept]


class _Forest:
    """Edges that close no ring; label: the component of each node."""

    def __init__(self, n: int):
        self.top, self.label, self.edges = list(range(n)), np.arange(n), []

    def find(self, a: int) -> int:
        while self.top[a] != a:
            self.top[a] = a = self.top[self.top[a]]
        return a

    def add(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        """Edges in their order."""
        for i, j, x in zip(a.tolist(), b.tolist(), w.tolist()):
            p, q = self.find(i), self.find(j)
            if p != q:
                self.top[p] = q
                self.edges.append((i, j, x))
        self.label = np.array([self.find(v) for v in range(len(self.top))])


def _between(x: np.ndarray, rows: slice, label: np.ndarray):
    """(a, b, length) of pairs a < b of different components, a in a block of rows."""
    a, b = np.nonzero(label[rows][:, None] != label[rows.start :][None])
    a, b = a[b > a] + rows.start, b[b > a] + rows.start
    total = 0.0
    for k in range(x.shape[1]):
        v = x[a, k] - x[b, k]
        total = total + v * v
    return a, b, np.sqrt(total)


def noisy_tree(pairs: _Noisy, n: int, at_once: int = 300_000) -> list[tuple[int, int, float]]:
    """The minimum spanning tree by (weight, rows). First the pairs of the least weight there is, which follow each other by their rows: a pair
    within a component comes after those that made it. Then the pairs between what is left, of which a forest is kept that bounds the rest."""
    tree = _Forest(n)
    if pairs.noise:
        for rows in _blocks(n, 16 * n):
            tree.add(*pairs.upto(*_between(pairs.x, rows, tree.label), LEAST))
    done, label, most, size = tree.edges, tree.label, np.inf, 0
    held: list[tuple] = []
    places = len(np.unique(label))

    def reduced():
        nonlocal most, held, size
        a, b, w = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((b, a, w))
        forest = _Forest(n)
        ends = np.stack([label[a[order]], label[b[order]]])
        kept = []
        for k, (p, q) in enumerate(zip(*ends.tolist())):
            p, q = forest.find(p), forest.find(q)
            if p != q:
                forest.top[p] = q
                kept.append(k)
                if len(kept) == places - 1:
                    break
        own = order[np.array(kept, int)]
        if len(kept) == places - 1 and kept:
            most = float(w[own[-1]])
        held, size = [(a[own], b[own], w[own])], len(own)

    for rows in _blocks(n):
        if places == 1:
            break
        held.append(pairs.upto(*_between(pairs.x, rows, label), most))
        size += len(held[-1][0])
        if size > at_once + 2 * places:
            reduced()
    if held:
        reduced()
        done = done + [*zip(*(c.tolist() for c in held[0]))]
    return done


def overlay(ids: np.ndarray, x: np.ndarray, first: list[tuple[int, int]], k: int, penalty: float, noise_scale: float, seed: int) -> dict[tuple[int, int], int]:
    """Pairs of rows in k trees, of which the first is given, with the number of trees that have them; ids ascend."""
    used = dict.fromkeys(first, 1)
    noise = noise_scale * mean_length(x) if noise_scale and len(x) > 1 else 0.0
    for turn in range(1, k if len(x) > 1 else 1):
        for a, b, _ in noisy_tree(_Noisy(ids, x, used, penalty, noise, seed + turn), len(x)):
            used[a, b] = used.get((a, b), 0) + 1
    return used
