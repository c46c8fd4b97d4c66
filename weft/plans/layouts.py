"""Sequential constructions: one task for each layout, many layouts side by side."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Points


def by_layout(frame: DataFrame) -> DataFrame:
    """The rows dealt by layout to as many partitions as are asked for, however small: a layout is long work even where its rows are few."""
    spark = frame.sparkSession
    return frame.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "layout")


def each_layout(points: Points, build: Callable[[np.ndarray, np.ndarray], list[tuple]], columns: str = "weight double") -> DataFrame:
    """build(features, ids) gives (row of one end, row of the other, values...) in rows ordered by id; edges carry the ids.

    A layout is one point set, which such a construction needs whole: its size bounds the task's memory."""
    frame = points.frame if points.keys else points.frame.withColumn("layout", F.lit(0))
    names = [c.split()[0] for c in columns.split(",") if c.strip()]

    def run(key, pdf):
        pdf = pdf.sort_values("id", kind="stable")
        ids, x = pdf["id"].to_numpy(), np.array(pdf["features"].tolist(), float).reshape(len(pdf), -1)
        rows = build(x, ids)
        out = {"layout": [key[0]] * len(rows), "src": [ids[r[0]] for r in rows], "dst": [ids[r[1]] for r in rows]}
        return pd.DataFrame(out | {c: [r[2 + k] for r in rows] for k, c in enumerate(names)})

    kind = frame.schema["layout"].dataType.simpleString()
    out = by_layout(frame.select("layout", "id", "features")).groupBy("layout").applyInPandas(run, f"layout {kind}, src long, dst long" + (f", {columns}" if columns else ""))
    return out if points.keys else out.drop("layout")
