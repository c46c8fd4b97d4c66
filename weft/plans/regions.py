"""Pairs in the plane that no third point parts, found near by: a tree's leaves look only as far as such a pair can reach."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Points

WAYS = 32  # directions, between which a pair's length is bounded


def finite(points: Points) -> bool:
    """Whether no id or coordinate is null or NaN."""
    bad = F.exists("features", lambda x: x.isNull() | F.isnan(x)) | F.col("features").isNull() | (F.size("features") != points.dims) | F.col("id").isNull()
    return not points.frame.filter(bad).limit(1).count()


def sliced(points: Points, rows: int = 2048, most: int | None = None) -> DataFrame:
    """(keys, part, parts, ids, features): each layout packed in one row, as often as there are parts to be worked on; ids ascend.

    A layout is gathered in one task and held by each that works on a part of it."""
    frame = points.frame if points.keys else points.frame.withColumn("layout", F.lit(0))
    most, dims = most or 4 * frame.sparkSession.sparkContext.defaultParallelism, points.dims

    def pack(key, pdf):
        pdf = pdf.sort_values("id", kind="stable")
        x = np.array(pdf["features"].tolist(), float).reshape(len(pdf), dims)
        parts = max(1, min(most, -(-len(pdf) // rows)))
        blob = (pdf["id"].to_numpy(np.int64).tobytes(), x.tobytes())
        return pd.DataFrame([(key[0], k, parts, *blob) for k in range(parts)], columns=["layout", "part", "parts", "ids", "features"])

    kind = frame.schema["layout"].dataType.simpleString()
    packed = frame.select("layout", "id", "features").groupBy("layout").applyInPandas(pack, f"layout {kind}, part int, parts int, ids binary, features binary")
    return packed.repartition(most)


def on_slices(points: Points, work: Callable, columns: str, rows: int = 2048) -> DataFrame:
    """work(ids, features, part, parts) gives, once or more often, arrays for src, dst and each of `columns`."""
    dims, kind = points.dims, (points.frame.schema["layout"].dataType.simpleString() if points.keys else "int")
    names = ["src", "dst", *(c.split()[0] for c in columns.split(",") if c.strip())]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["features"], float).reshape(-1, dims)
                for got in work(ids, x, row["part"], row["parts"]):
                    for i in range(0, len(got[0]), 1 << 20):
                        own = [pa.array(g[i : i + (1 << 20)]) for g in got]
                        layout = pa.repeat(pa.scalar(row["layout"], batch.schema.field("layout").type), len(own[0]))
                        yield pa.RecordBatch.from_arrays([layout, *own], names=["layout", *names])

    out = sliced(points, rows).mapInArrow(run, f"layout {kind}, src long, dst long" + (f", {columns}" if columns else ""))
    return out if points.keys else out.drop("layout")


def leaves(x: np.ndarray, size: int = 64) -> list[np.ndarray]:
    """Rows of a tree's leaves, split at the middle of the wider side."""
    out, rest = [], [np.arange(len(x))]
    while rest:
        own = rest.pop()
        if len(own) <= size:
            out.append(own)
            continue
        axis = int(np.argmax(np.ptp(x[own], axis=0)))
        own = own[np.argpartition(x[own, axis], len(own) // 2)]
        rest += [own[: len(own) // 2], own[len(own) // 2 :]]
    return out


def _reach(v: np.ndarray, squares: np.ndarray, near: int = 32) -> np.ndarray:
    """For each row's own point (at 0) and each sector between two directions how long a pair without a point in its diametral
    ball can be at most: a point r ends it where it turns the corner, at |r| / cos of the angle. v: (rows, others, 2)."""
    k = min(near, squares.shape[1] - 1)
    own = np.argpartition(squares, k, axis=1)[:, : k + 1] if k + 1 < squares.shape[1] else np.broadcast_to(np.arange(squares.shape[1]), squares.shape)
    d, w = np.take_along_axis(squares, own, 1), np.take_along_axis(v, own[:, :, None], 1)
    angle = 2 * np.pi * np.arange(WAYS) / WAYS
    along = w @ np.stack([np.cos(angle), np.sin(angle)])  # rows, near, ways
    with np.errstate(divide="ignore", invalid="ignore"):
        end = np.where((along > 1e-12 * np.sqrt(d)[:, :, None]) & (d > 0)[:, :, None], d[:, :, None] / along, np.inf)
    return np.maximum(end, np.roll(end, -1, axis=2)).min(1) * (1 + 1e-9)


def empty_pairs(x: np.ndarray, inside: Callable, part: int = 0, parts: int = 1):
    """(i, j, squared length) for rows of different places i < j, of a part of the leaves, that no third place parts. inside: as for
    empty_region; the region must hold the diametral ball and no point further from an end than the other end is."""
    boxes = leaves(x)
    low, high = np.array([x[b].min(0) for b in boxes]).reshape(-1, 2), np.array([x[b].max(0) for b in boxes]).reshape(-1, 2)
    everything = float(np.linalg.norm(np.ptp(x, axis=0))) * (1 + 1e-9) if len(x) else 0.0
    for number in range(part, len(boxes), parts):
        own, wide = boxes[number], 2 * float((high[number] - low[number]).max())
        while len(own):
            at_low, at_high = x[own].min(0), x[own].max(0)
            wide = min(max(wide, everything * 1e-6), everything)
            gap = np.maximum(0, np.maximum(low - at_high, at_low - high))
            there = np.concatenate([boxes[k] for k in np.nonzero((gap**2).sum(1) <= (wide * (1 + 1e-9)) ** 2)[0]])
            last, later, step = wide >= everything, [], max(1, 4_000_000 // (len(there) * 4))
            for some in (own[s : s + step] for s in range(0, len(own), step)):
                v = x[there][None] - x[some][:, None]
                squares = v[:, :, 0] * v[:, :, 0] + v[:, :, 1] * v[:, :, 1]
                reach = _reach(v, squares)
                settled = np.ones(len(some), bool) if last else reach.max(1) <= wide
                later.append(some[~settled])
                sector = np.floor(np.arctan2(v[:, :, 1], v[:, :, 0]) % (2 * np.pi) / (2 * np.pi / WAYS)).astype(int) % WAYS
                most = np.maximum(np.maximum(np.take_along_axis(reach, sector, 1), np.take_along_axis(reach, (sector + 1) % WAYS, 1)), np.take_along_axis(reach, (sector - 1) % WAYS, 1))
                i, j = np.nonzero(settled[:, None] & (some[:, None] < there[None]) & (squares <= most * most))
                if not len(i):
                    continue
                c, kept = squares[i, j], np.ones(len(i), bool)
                order = np.argpartition(squares, 39, axis=1)[:, :40] if len(there) > 40 else np.broadcast_to(np.arange(len(there)), squares.shape)  # most pairs are parted by a point near to an end
                for m in range(order.shape[1]):
                    live = np.nonzero(kept)[0]
                    r = order[i[live], m]
                    b = x[there[r]] - x[there[j[live]]]
                    kept[live] = (r == j[live]) | (there[r] == some[i[live]]) | ~inside(squares[i[live], r], b[:, 0] * b[:, 0] + b[:, 1] * b[:, 1], c[live])
                live = np.nonzero(kept)[0]
                for s in range(0, len(live), more := max(1, 2_000_000 // len(there))):
                    k = live[s : s + more]
                    b = x[there][None] - x[there[j[k]]][:, None]
                    hit = inside(squares[i[k]], b[:, :, 0] * b[:, :, 0] + b[:, :, 1] * b[:, :, 1], c[k][:, None])
                    hit &= (there[None] != some[i[k]][:, None]) & (there[None] != there[j[k]][:, None])
                    kept[k] = ~hit.any(1)
                yield some[i[kept]], there[j[kept]], c[kept]
            own, wide = np.concatenate(later), 2 * wide


def places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different places; the rows by place, in their order; and where each place's rows begin."""
    at, back, n = np.unique(x + 0.0, axis=0, return_inverse=True, return_counts=True)
    return at, np.argsort(back.reshape(-1), kind="stable"), np.concatenate([[0], np.cumsum(n)])


def empty_in_plane(points: Points, inside: Callable, one: bool = False) -> DataFrame:
    """keys, src, dst, weight of pairs that no third point parts. Copies of an end part nothing: places are tried once, and each edge
    stands for all pairs of copies; or, if `one`, for the first by ids, and copies are linked to their first."""

    def work(ids, x, part, parts):
        at, rows, begin = places(x)
        ids = ids[rows]
        for i, j, c in empty_pairs(at, inside, part, parts):
            if one:
                a, b = ids[begin[i]], ids[begin[j]]
                yield np.minimum(a, b), np.maximum(a, b), np.sqrt(c)
                continue
            m, n = begin[i + 1] - begin[i], begin[j + 1] - begin[j]
            for s in range(0, len(i), 4096):
                own = slice(s, s + 4096)
                for e, k in zip(*_blocks(m[own] * n[own])):
                    e = e + s
                    a, b = ids[begin[i[e]] + k // n[e]], ids[begin[j[e]] + k % n[e]]
                    yield np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], np.sqrt(c[e])[a != b]
        size = np.diff(begin)
        for p in np.nonzero(size > 1)[0]:
            if p % parts == part:
                own = ids[begin[p] : begin[p + 1]]
                for s in range(1 if one else len(own)):
                    b = own[s + 1 :][own[s + 1 :] != own[s]]
                    yield np.full(len(b), own[s]), b, np.zeros(len(b))

    return on_slices(points, work, "weight double")


def _blocks(sizes: np.ndarray, most: int = 1 << 20):
    """Rows of a number of groups: which group, and which row in it, in blocks."""
    ends = np.cumsum(sizes)
    total, firsts = int(ends[-1]) if len(ends) else 0, ends - sizes
    which, place = [], []
    for s in range(0, total, most):
        row = np.arange(s, min(total, s + most))
        e = np.searchsorted(ends, row, side="right")
        which.append(e)
        place.append(row - firsts[e])
    return which, place
