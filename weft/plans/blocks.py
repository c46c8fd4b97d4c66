"""All pairs of points in the plane, in an order that columnar files hold in little room: points of a cell against points of a cell, near
cells first, so that ids recur in the same order and a task's lengths, once rounded, are few. Medians of all lengths by counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Points
from .scratch import cut

ROWS = 32_000_000  # of a task: one row group of its file
CHUNK = 1 << 19
PER_SIDE, SIDE = 40, 6  # cells of a side at most; the root of the points that a cell holds
BINS, FEW = 1 << 14, 1_000_000
MOST = 1e150


def plain(points: Points) -> bool:
    """Whether the points lie in the plane, with long ids and numbers whose products are finite."""
    if points.dims != 2 or points.frame.schema["id"].dataType.simpleString() != "bigint":
        return False
    bad = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > MOST)) | F.col("features").isNull() | (F.size("features") != 2) | F.col("id").isNull()
    return not points.frame.filter(bad).limit(1).count()


def cells(x: np.ndarray, per_side: int = PER_SIDE, side: int = SIDE) -> list[np.ndarray]:
    """Rows by cell of a grid, in their order; a cell that holds too many comes in pieces."""
    low, wide = x.min(0), float(np.ptp(x, axis=0).max()) or 1.0
    sides, most = max(1, min(per_side, int(len(x) ** 0.5 / side))), max(64, len(x) // 128)
    at = np.minimum(sides - 1, np.floor((x - low) / wide * sides)).astype(int) @ np.array([sides, 1])
    order = np.argsort(at, kind="stable")
    whole = np.split(order, np.nonzero(np.diff(at[order]))[0] + 1)
    return [own[s : s + most] for own in whole for s in range(0, len(own), most)]


def blocks(x: np.ndarray, part: int, parts: int, *grid: int):
    """(rows of a cell, rows of a cell) of a part of all pairs of cells, a cell with itself included: near ones first, parts of equal work."""
    own = cells(x, *grid)
    size, middle = np.array([len(c) for c in own]), np.array([x[c].mean(0) for c in own])
    p, q = np.triu_indices(len(own))
    work = np.where(p == q, size[p] * (size[p] - 1) // 2, size[p] * size[q])
    far = np.argsort(np.hypot(*(middle[p] - middle[q]).T), kind="stable")
    part_of = (np.cumsum(work[far]) - work[far]) * parts // max(1, int(work.sum()))
    for k in far[np.minimum(part_of, parts - 1) == part]:
        yield own[p[k]], own[q[k]]


def ascending(a: np.ndarray, b: np.ndarray, few: int = 2048):
    """(i, j) with i < j for all pairs of an ascending a and an ascending b, as rectangles as far as they go; of a with itself once."""
    if not len(a) or not len(b):
        return
    same = a is b
    if not same and (a[-1] < b[0] or b[-1] < a[0]):
        low, high = (a, b) if a[-1] < b[0] else (b, a)
        yield np.repeat(low, len(high)), np.tile(high, len(low))
    elif len(a) * len(b) <= few:
        i, j = np.triu_indices(len(a), 1) if same else (np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)))
        yield np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
    else:
        value = a[len(a) // 2] if len(a) >= len(b) else b[len(b) // 2]
        i, j = np.searchsorted(a, value), np.searchsorted(b, value)
        left, right = a[:i], a[i:]
        yield from ascending(left, b[j:])
        if not same:
            yield from ascending(b[:j], right)
        yield from ascending(left, left if same else b[:j])
        yield from ascending(right, right if same else b[j:])


def chunks(x: np.ndarray, part: int, parts: int, *grid: int):
    """(i, j, length) with i < j of a part of all pairs, in chunks."""
    found, n, first = [], 0, True
    for a, b in blocks(x, part, parts, *grid):
        for s in range(0, len(a), step := max(1, 2 * CHUNK // len(b))):
            own = a[s : s + step]
            tries = [(own, own), (own, a[s + step :])] if a is b else [(own, b)]
            for e, f in tries:
                for got in ascending(e, f):
                    found.append(got)
                    n += len(got[0])
                    if n >= CHUNK:
                        yield _measured(x, found, first)
                        found, n, first = [], 0, False
    if n:
        yield _measured(x, found, first)


def _measured(x: np.ndarray, found: list, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = (np.concatenate(c) for c in zip(*found))
    dx, dy = x[i, 0] - x[j, 0], x[i, 1] - x[j, 1]
    d = np.sqrt(dx * dx + dy * dy)
    if first:  # a file's writer settles by the first page whether values recur
        order = np.argsort(d, kind="stable")
        i, j, d = i[order], j[order], d[order]
    return i, j, d


def _parts(points: Points) -> DataFrame:
    """(layout, part, parts, ids, features): each layout packed in one row, as often as there are parts of its pairs; points come as one broadcast row."""
    frame = points.frame if points.keys else points.frame.withColumn("layout", F.lit(0))
    spark, kind = frame.sparkSession, frame.schema["layout"].dataType.simpleString()
    most = 4 * spark.sparkContext.defaultParallelism

    def pack(key, pdf):
        pdf = pdf.sort_values("id", kind="stable")
        n, x = len(pdf), np.array(pdf["features"].tolist(), float).reshape(len(pdf), 2)
        parts = max(1, min(most, -(-n // 2048)), -(-n * n // (2 * ROWS)))
        return pd.DataFrame([(key[0], parts, pdf["id"].to_numpy(np.int64).tobytes(), x.tobytes())], columns=["layout", "parts", "ids", "features"])

    packed = cut(frame.select("layout", "id", "features").groupBy("layout").applyInPandas(pack, f"layout {kind}, parts int, ids binary, features binary"))
    total = packed.agg(F.sum("parts").cast("int")).first()[0] or 1
    parts = packed.select("layout", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(total)
    return parts.join(F.broadcast(packed.withColumnRenamed("layout", "layout_b")), F.col("layout").eqNullSafe(F.col("layout_b"))).drop("layout_b")


def all_pairs(points: Points, keep: Callable | None = None, weigh: Callable | None = None, grid: tuple[int, int] = (PER_SIDE, SIDE)) -> DataFrame:
    """keys, src, dst, weight: src < dst. keep(x) gives a function of (i, j) that says which of a layout's pairs stay. weigh(layout, lengths)
    gives the weights in the place of lengths and which of them stay. grid: what cells() takes.

    Each task holds one layout whole, and takes a part of its pairs."""
    keys = points.keys

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["features"], float).reshape(-1, 2)
                copies, stays = bool((ids[1:] == ids[:-1]).any()), keep(x) if keep else None
                for i, j, d in chunks(x, row["part"], row["parts"], *grid):
                    if copies or stays or weigh:
                        own = ids[i] != ids[j] if copies else np.ones(len(i), bool)
                        if stays:
                            own &= stays(i, j)
                        if weigh:
                            d, good = weigh(row["layout"], d)
                            own &= good
                        i, j, d = i[own], j[own], d[own]
                    layout = [pa.repeat(pa.scalar(row["layout"], batch.schema.field("layout").type), len(i))] if keys else []
                    yield pa.RecordBatch.from_arrays([*layout, pa.array(ids[i]), pa.array(ids[j]), pa.array(d)], names=[*keys, "src", "dst", "weight"])

    whole = _parts(points)
    kind = whole.schema["layout"].dataType.simpleString()
    return whole.mapInArrow(run, (f"layout {kind}, " if keys else "") + "src long, dst long, weight double")


def lengths(ids: np.ndarray, x: np.ndarray, part: int, parts: int, ranges: list[tuple[int, int]] | None = None):
    """Lengths of a part of all pairs of different ids, as whole numbers in the same order (a double's bits), in chunks. ranges: pairs of cells
    whose lengths are in none of them may be left out."""
    own, copies = cells(x), bool((ids[1:] == ids[:-1]).any())
    low, high = np.array([x[c].min(0) for c in own]), np.array([x[c].max(0) for c in own])
    p, q = (k[part::parts] for k in np.triu_indices(len(own)))
    if ranges is not None:
        gap = np.maximum(0, np.maximum(low[p] - high[q], low[q] - high[p]))
        least = (np.hypot(*gap.T) * (1 - 1e-9)).view(np.int64)
        most = (np.hypot(*(np.maximum(high[p], high[q]) - np.minimum(low[p], low[q])).T) * (1 + 1e-9)).view(np.int64)
        there = np.any([(least <= hi) & (most >= lo) for lo, hi in ranges], axis=0)
        p, q = p[there], q[there]
    found, n = [], 0
    for a, b in zip(p, q):
        one, other = own[a], own[b]
        for s in range(0, len(one), step := max(1, 2 * CHUNK // len(other))):
            some = one[s : s + step]
            dx, dy = x[some, None, 0] - x[other, 0], x[some, None, 1] - x[other, 1]
            d = np.sqrt(dx * dx + dy * dy)
            counts = (some[:, None] < other if a == b else np.ones(d.shape, bool)) & (ids[some, None] != ids[other]) if a == b or copies else None
            found.append(d.ravel() if counts is None else d[counts])
            n += len(found[-1])
            if n >= CHUNK:
                yield np.concatenate(found).view(np.int64)
                found, n = [], 0
    if n:
        yield np.concatenate(found).view(np.int64)


def medians(points: Points, most_layouts: int = 200) -> dict | None:
    """The exact, interpolated median of the lengths of all pairs, by layout (0 where there are no keys), as F.median has it; None if there
    are too many layouts. Counts in BINS narrow down where the one or two lengths in the middle are; each turn computes lengths anew, but only
    of cells between which they can be. A layout without pairs has none."""
    whole = _parts(points)
    kind = whole.schema["layout"].dataType.simpleString()
    layouts = [r[0] for r in whole.select("layout").distinct().limit(most_layouts + 1).collect()]
    if len(layouts) > most_layouts:
        return None

    def counted(wanted: dict) -> dict:
        """(layout, lo, bin) with counts, for (lo, hi, shift) of each layout; a bin holds 2^shift numbers."""

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    ranges = wanted.get(row["layout"], [])
                    if not ranges:
                        continue
                    sums = [Counter() if (hi - lo) >> shift >= BINS else np.zeros(BINS, np.int64) for lo, hi, shift in ranges]
                    ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["features"], float).reshape(-1, 2)
                    limits = None if ranges == [first] else [(lo, hi) for lo, hi, _ in ranges]
                    for bits in lengths(ids, x, row["part"], row["parts"], limits):
                        for (lo, hi, shift), total in zip(ranges, sums):
                            k = (bits[(bits >= lo) & (bits <= hi)] if limits else bits) - lo >> shift
                            if isinstance(total, Counter):
                                total.update(dict(zip(*(v.tolist() for v in np.unique(k, return_counts=True)))))
                            else:
                                total += np.bincount(k, minlength=BINS)
                    for (lo, _, _), total in zip(ranges, sums):
                        bins = np.array([*total], np.int64) if isinstance(total, Counter) else np.nonzero(total)[0]
                        n = np.array([*total.values()], np.int64) if isinstance(total, Counter) else total[bins]
                        layout = pa.repeat(pa.scalar(row["layout"], batch.schema.field("layout").type), len(bins))
                        yield pa.RecordBatch.from_arrays([layout, pa.array(np.full(len(bins), lo)), pa.array(bins), pa.array(n)], names=["layout", "lo", "bin", "n"])

        rows = whole.mapInArrow(run, f"layout {kind}, lo long, bin long, n long").groupBy("layout", "lo", "bin").agg(F.sum("n").alias("n")).collect()
        out: dict = {}
        for r in sorted(rows, key=lambda r: r["bin"]):
            out.setdefault((r["layout"], r["lo"]), []).append((r["bin"], r["n"]))
        return out

    top = int(np.float64(4 * MOST).view(np.int64))
    first = (0, top, max(0, top.bit_length() - BINS.bit_length() + 1))
    at: dict = {}
    bits: dict = {}
    left = {(layout, k): (*first, None) for layout in layouts for k in (0, 1)}  # the lower and the upper one in the middle: lo, hi, shift, rank from lo on
    while left:
        found = counted({layout: sorted({left[layout, k][:3] for k in (0, 1) if (layout, k) in left}) for layout in {key for key, _ in left}})
        for (layout, k), (lo, hi, shift, rank) in [*left.items()]:
            del left[layout, k]
            rows = found.get((layout, lo), [])
            if rank is None:
                if not rows:
                    continue
                at[layout] = 0.5 * (sum(n for _, n in rows) - 1)
                rank = (floor, ceil)[k](at[layout])
            for place, n in rows:
                if rank < n:
                    break
                rank -= n
            begin = lo + (place << shift)
            if shift == 0:
                bits[layout, k] = begin
            else:
                left[layout, k] = (begin, begin + (1 << shift) - 1, 0 if n <= FEW else max(0, shift - BINS.bit_length() + 1), rank)
    a, b = ({layout: float(np.int64(bits[layout, k]).view(np.float64)) for layout in at} for k in (0, 1))
    return {layout: a[layout] if a[layout] == b[layout] else (ceil(v) - v) * a[layout] + (v - floor(v)) * b[layout] for layout, v in at.items()}
