"""SentencePiece encoding and decoding with a merge-type (BPE) model: a prefix table.

A merge-type model joins, again and again, the neighbouring pair whose joined piece scores best,
the leftmost of equals. The ids of a text are then the one sequence in which every two neighbours
are compatible, that is, in which the merges on the two pieces' characters alone give back just the
two. So each prefix of a text has a unique last piece, and it can be found from left to right: of the
pieces that end there (the matches of an Aho-Corasick automaton of all pieces, by length) it is the
one that is compatible with the last piece of the prefix before it. Only that piece is kept for each
prefix; the ids are read off backwards. Characters outside the vocabulary become their UTF-8 bytes'
pieces and part the text. No piece holds a space mark after another character (checked when the model
is read), so a text is cut there, and equal words are encoded once per task.

The model's path is a parameter; each task reads the file that the driver has read, sent with the code. Models
that change texts before they are cut (a normaliser, dropped spaces) are refused.

Defined results: null or empty texts have no pieces (with an end id: just that one) and decode to an empty text. Rows that
repeat give repeated results, null ids stay null, an empty table gives an empty result; of equally good merges the
leftmost comes first, as in the library. Columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import re
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MARK = "▁"

# Characters that the usual normalisers replace, and what by.
NORMALISED = (("\uff21", "A"), ("\ufb01", "fi"), ("e\u0301", "\u00e9"), ("\u2460", "1"), ("A", "a"))


class MergeModel:
    """The pieces of a merge-type model, and encoding by prefix table."""

    def __init__(self, proto: bytes, most_words: int = 300_000, most_pairs: int = 600_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.end_id, self.unknown_id, self.most_words, self.most_pairs = sp.eos_id(), sp.unk_id(), most_words, most_pairs
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids, self.table, ids = {}, [], {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.table.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i):
                self.table.append(b"")
            elif sp.is_unknown(i):
                self.table.append(b" \xe2\x81\x87 ")
            else:
                self.table.append(piece.replace(MARK, " ").encode())
                ids[piece] = i
        if any(sp.is_unused(i) for i in range(n)) or any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a model with unused pieces, or with a space mark inside a piece, isn't provided for")
        if any(sp.encode(x) == sp.encode(y) for x, y in NORMALISED):
            raise ValueError("a model with a normaliser isn't provided for")
        if any(x != i for x, i in zip(sp.encode("a b"), sp.encode("a  b"))) and sp.encode("a  b") == sp.encode("a b"):
            raise ValueError("a model that drops spaces isn't provided for")
        self.ids, self.score = ids, {p: sp.get_score(i) for p, i in ids.items()}
        self.dummy = bool(sp.encode("a")) and sp.id_to_piece(sp.encode("a")[0]).startswith(MARK)
        self.automaton = ahocorasick.Automaton()
        own = {p: i for p, i in ids.items() if self.merged(p) == [p]}  # a piece that merging never makes is never a last piece
        for piece, i in own.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.sizes = [len(p) for p in self.pieces]
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.letters = {p for p in own if len(p) == 1}
        if any(c not in self.letters for p in ids for c in p):
            raise ValueError("a model whose pieces hold characters that aren't pieces isn't provided for")
        self.newline = self._bytes(self.encode_run("\n"))
        self.cut = re.compile(f"{MARK}*[^{MARK}]*")

    def merged(self, text: str) -> list[str]:
        """Merging as defined, with a queue: for short strings, and to check the table."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-s, i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, piece = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or parts[i] + parts[j] != piece or right[i] != j:
                continue
            parts[i], parts[j], right[i] = piece, None, right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges on the characters of pieces a and b together give back a and b."""
        x, y = self.pieces[a], self.pieces[b]
        known = self.merged(x + y) == [x, y]
        if len(self.fits) < self.most_pairs:
            self.fits[a * len(self.pieces) + b] = known
        return known

    def encode_run(self, text: str) -> list[int]:
        """Ids of characters without the space mark inside, by the prefix table."""
        if not self.letters.issuperset(text):
            return self._encode_mixed(text)
        begin, pieces, fits = -1, len(self.pieces), self.fits
        last = [0] * (len(text) + 1)  # the last piece of each prefix; 0: not known yet
        last[0] = begin
        for at, (piece, size) in self.automaton.iter(text):  # all pieces that end at each place
            if last[at + 1]:
                continue
            before = last[at + 1 - size]
            if before != begin:
                fit = fits.get(before * pieces + piece)
                if not (self.compatible(before, piece) if fit is None else fit):
                    continue
            last[at + 1] = piece
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= self.sizes[last[at]]
        return out[::-1]

    def _encode_mixed(self, text: str) -> list[int]:
        """The same where some characters aren't in the vocabulary: these become bytes and part the rest."""
        out: list[int] = []
        for known, part in groupby(text, self.letters.__contains__):
            if known:
                out += self.encode_run("".join(part))
            else:
                for c in part:
                    out += [self.byte_ids.get(b, self.unknown_id) for b in c.encode()] if self.byte_ids else [self.unknown_id]
        return out

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.asarray(ids, np.int32).tobytes()

    def _word(self, word: str, cache: dict[str, bytes], mark: str) -> bytes:
        out = self._bytes(self.encode_run(mark + word))
        if len(cache) < self.most_words and len(word) < 32:  # frequent words come early
            cache[word] = out
        return out

    def encode(self, text: str, end: bool = True) -> bytes:
        """Ids of a text, as bytes of int32."""
        out: list[bytes] = []
        if text:
            if MARK in text or "  " in text or not self.dummy or text[0] == " " or " \n" in text or text[-1] == " ":
                full = (MARK if self.dummy else "") + text.replace(" ", MARK)
                for run in self.cut.findall(full):
                    if run:
                        out.append(self.starts.get(run) or self._word(run, self.starts, ""))
            else:
                words, starts, newline = self.words, self.starts, self.newline
                for k, line in enumerate(text.split("\n")):
                    parts = line.split(" ")
                    if k:
                        out.append(newline)
                        if first := parts[0]:
                            out.append(starts.get(first) or self._word(first, starts, ""))
                        parts = parts[1:]
                    for word in parts:
                        out.append(words.get(word) or self._word(word, words, MARK))
        if end:
            out.append(self._bytes([self.end_id]))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; a byte that isn't UTF-8 in its place becomes one U+FFFD."""
        ids = ids.tolist()
        raw = list(map(self.table.__getitem__, ids))
        if self.dummy and (k := next((k for k, x in enumerate(raw) if x), -1)) >= 0 and self.pieces[ids[k]].startswith(MARK):
            raw[k] = raw[k][1:]
        try:
            return b"".join(raw).decode()
        except UnicodeDecodeError:
            return self._decode_bad(b"".join(raw))

    @staticmethod
    def _decode_bad(raw: bytes) -> str:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


_models: dict[bytes, MergeModel] = {}  # of this worker, with the words it has met; one model at a time


def model_of(proto: bytes) -> MergeModel:
    if proto not in _models:
        _models.clear()
        _models[proto] = MergeModel(proto)
    return _models[proto]


def read_model(path: str) -> bytes:
    """A model file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


def sentencepiece_round_trip(documents: DataFrame, proto: bytes, end: bool = True) -> DataFrame:
    """Each text's ids, and the text that they decode to."""

    def make():
        model = model_of(proto)

        def each(batch):
            for low in range(0, batch.num_rows, 500):  # ids of a part of a batch at a time
                part = batch.slice(low, 500)
                ids = [np.frombuffer(model.encode(x or "", end), np.int32) for x in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([model.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

        return each

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, ids array<int>, decoded string")


def sentencepiece_digest(coded: DataFrame) -> DataFrame:
    """The columns of op2."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col("decoded"), "UTF-8"), 256).alias("decoded_sha256"),
    )
