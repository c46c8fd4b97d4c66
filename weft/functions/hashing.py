"""The hashed draws of functions.vectors.uniform for many pairs at once: md5 over arrays."""

from __future__ import annotations

import hashlib

import numpy as np

_K = [int(abs(np.sin(np.float64(i + 1))) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [*[7, 12, 17, 22] * 4, *[5, 9, 14, 20] * 4, *[4, 11, 16, 23] * 4, *[6, 10, 15, 21] * 4]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(words: list) -> np.ndarray:
    """The first 32 bits of md5 of one block, as a number; words: 16 ints or arrays (uint32) of one length."""
    n = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = _START
    first = next(i for i, w in enumerate(words) if isinstance(w, np.ndarray))
    for i in range(first):  # alike for all
        f = (((d ^ (b & (c ^ d))) + a + _K[i] + words[i]) & 0xFFFFFFFF)
        a, d, c, b = d, c, b, (((f << _TURNS[i]) | (f >> (32 - _TURNS[i]))) + b) & 0xFFFFFFFF
    a, b, c, d = (np.full(n, x, np.uint32) for x in (a, b, c, d))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(first, 61):  # the last three only move the first word on
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        w = words[_WORD[i]]
        np.add(f, a, out=f)
        if isinstance(w, np.ndarray):
            np.add(f, w, out=f)
            w = 0
        np.add(f, np.uint32((_K[i] + w) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    np.add(b, np.uint32(_START[0]), out=b)
    return b.byteswap()


class Draws:
    """First 32 bits of md5(before + id + after) for ids in their order; `before` is another for each call."""

    def __init__(self, ids: np.ndarray, after: bytes = b"", block: int = 16_384):
        self.text, self.after, self.block = ids.astype("S21"), after, block
        long = np.char.str_len(self.text)
        self.kinds = [(int(n), np.nonzero(long == n)[0]) for n in np.unique(long)]
        self.words: dict = {}

    def _of(self, n: int, rows: np.ndarray, shift: int) -> np.ndarray:
        """Words of the ids with n digits, from the byte `shift` of a word on, with what follows and the closing bit."""
        if (n, shift) not in self.words:
            tail = self.after + b"\x80"
            wide = -(-(shift + n + len(tail)) // 4) * 4
            out = np.zeros((len(rows), wide), np.uint8)
            out[:, shift : shift + n] = np.ascontiguousarray(self.text[rows]).view(np.uint8).reshape(len(rows), -1)[:, :n]
            out[:, shift + n : shift + n + len(tail)] = np.frombuffer(tail, np.uint8)
            self.words[n, shift] = np.ascontiguousarray(out.view("<u4").T)
        return self.words[n, shift]

    def __call__(self, before: bytes, start: int = 0):
        """(rows, draws) in blocks, for ids from row `start` on."""
        whole, rest = divmod(len(before), 4)
        for n, rows in self.kinds:
            first = int(np.searchsorted(rows, start))
            if first == len(rows):
                continue
            size = len(before) + n + len(self.after)
            if size > 55:  # more than a block
                own = rows[first:]
                yield own, np.array([int(hashlib.md5(before + self.text[r] + self.after).hexdigest()[:8], 16) for r in own], np.uint32)
                continue
            mine = self._of(n, rows, rest)
            head = [int.from_bytes(before[4 * k : 4 * k + 4], "little") for k in range(whole)]
            part = np.uint32(int.from_bytes(before[4 * whole :], "little"))
            for s in range(first, len(rows), self.block):
                words = [*head, *(w[s : s + self.block] for w in mine)]
                words[whole] = words[whole] | part
                words += [0] * (14 - len(words)) + [8 * size, 0]
                yield rows[s : s + self.block], _first_words(words)


def pair_draws(before: bytes, texts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, after: bytes = b"", block: int = 65_536) -> np.ndarray:
    """First 32 bits of md5(before + text of a + ":" + text of b + after) for pairs of rows; texts: bytes of a number of ids, one row each."""
    out, kind = np.empty(len(a), np.uint32), lengths[a] * 32 + lengths[b]
    for k in np.unique(kind):
        own, m, n = np.nonzero(kind == k)[0], int(k) // 32, int(k) % 32
        tail, start = after + b"\x80", len(before)
        size = start + m + 1 + n + len(after)
        for s in range(0, len(own), block):
            rows = own[s : s + block]
            if size > 55:  # more than a block
                out[rows] = [int(hashlib.md5(before + bytes(texts[i, :m]) + b":" + bytes(texts[j, :n]) + after).hexdigest()[:8], 16) for i, j in zip(a[rows], b[rows])]
                continue
            text = np.zeros((len(rows), -(-(size + 1) // 4) * 4), np.uint8)
            text[:, :start] = np.frombuffer(before, np.uint8)
            text[:, start : start + m] = texts[a[rows], :m]
            text[:, start + m] = 58
            text[:, start + m + 1 : start + m + 1 + n] = texts[b[rows], :n]
            text[:, size - len(after) : size - len(after) + len(tail)] = np.frombuffer(tail, np.uint8)
            words = [*np.ascontiguousarray(text.view("<u4").T)]
            out[rows] = _first_words([*words, *[0] * (14 - len(words)), 8 * size, 0])
    return out
