"""Exact percentiles of more values than a task may hold."""

from __future__ import annotations

from math import ceil, floor, isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def percentile(frame: DataFrame, keys: tuple[str, ...], column: str, p: float, bins: int = 16_384, few: int = 1_000_000, most_keys: int = 200) -> DataFrame:
    """(keys, value): the exact, interpolated percentile of a column of doubles, as F.percentile has it, which keeps each value in a
    table of one task. Here counts in `bins` narrow down where the two values around it are, again until few values are left;
    each turn computes the frame anew. Groups beyond most_keys, and infinite or NaN values, go by F.percentile."""
    x, spark = F.col(column), frame.sparkSession
    whole = frame.select(*keys, x.alias("x"))
    known = whole.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).limit(most_keys + 1).collect()
    if len(known) > most_keys or any(r["n"] and not (isfinite(r["lo"]) and isfinite(r["hi"])) for r in known):
        return frame.groupBy(*keys).agg(F.percentile(column, F.lit(p)).alias("value"))
    at, found, left = {}, {}, {}
    for r in known:
        key = tuple(r[k] for k in keys)
        at[key] = p * (r["n"] - 1)
        found[key] = None
        if r["n"]:
            left[key] = (r["lo"], r["hi"], r["n"], 0)  # from, to, values between, values below
    kind = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)

    def between(some: dict) -> DataFrame:
        rows = spark.createDataFrame([(*key, lo, hi) for key, (lo, hi, *_) in some.items()], ", ".join(filter(None, (kind, "lo double, hi double"))))
        joined = whole.join(F.broadcast(rows), [*keys]) if keys else whole.crossJoin(F.broadcast(rows))  # one row
        return joined.filter("x >= lo and x <= hi")

    def ranked(rows: list[tuple], below: int, rank: int):
        for row in rows:
            if rank < below + row[-1]:
                return row, below
            below += row[-1]
        raise AssertionError("counts changed from one turn to the next")

    while left:
        for key, (lo, hi, n, _) in [*left.items()]:
            if lo == hi:
                found[key] = lo
                del left[key]
        small, room = {}, few
        for key, own in left.items():
            if own[2] <= room:
                small[key], room = own, room - own[2]
        if small:
            values: dict = {key: [] for key in small}
            for r in between(small).groupBy(*keys, "x").agg(F.count("*").alias("n")).collect():
                values[tuple(r[k] for k in keys)].append((r["x"], r["n"]))
            for key, rows in values.items():
                rows.sort()
                (a, _), (b, _) = (ranked(rows, left[key][3], f(at[key]))[0] for f in (floor, ceil))
                found[key] = a if a == b else (ceil(at[key]) - at[key]) * a + (at[key] - floor(at[key])) * b
                del left[key]
        wide = {key: own for key, own in left.items()}
        if wide:
            place = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
            counts: dict = {key: [] for key in wide}
            for r in between(wide).groupBy(*keys, place.alias("bin")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect():
                counts[tuple(r[k] for k in keys)].append((r["bin"], r["lo"], r["hi"], r["n"]))
            for key, rows in counts.items():
                rows.sort()
                (a, below), (b, _) = (ranked(rows, left[key][3], f(at[key])) for f in (floor, ceil))
                left[key] = (a[1], b[2], a[3] if a is b else a[3] + b[3], below)
    return spark.createDataFrame([(*key, value) for key, value in found.items()], ", ".join(filter(None, (kind, "value double"))))
