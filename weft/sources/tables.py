"""Points, series, observations and degrees from tables, and layouts drawn by formula."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matrices import nearest_positive_definite


@dataclass(frozen=True)
class Points:
    """A point set: id, features (array of doubles), label; with `layout` where it holds many sets."""

    frame: DataFrame
    dims: int
    keys: tuple[str, ...] = ()

    def checked(self, least: int = 2) -> Points:
        """Raise ValueError where a set has too few points, or a null or NaN among its values."""
        bad = F.exists("features", lambda x: x.isNull() | F.isnan(x)) | F.col("features").isNull() | F.col("id").isNull()
        row = self.frame.groupBy(*self.keys).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).agg(F.min("n").alias("n"), F.sum("bad").alias("bad")).first()
        if not row["n"] or row["n"] < least or row["bad"]:
            raise ValueError(f"each layout needs {least} points at least, without nulls")
        return self

    def counts(self) -> DataFrame:
        """For each layout the number of points and of clusters (distinct labels)."""
        return self.frame.groupBy(*self.keys).agg(F.count("*").alias("n_points"), F.count_distinct("label").alias("n_clusters"))

    def plane(self) -> DataFrame:
        """The points with x and y as columns."""
        return self.frame.select(*self.keys, "id", F.get("features", F.lit(0)).alias("x"), F.get("features", F.lit(1)).alias("y"), "label")

    def cluster(self, label: int) -> Points:
        """The points of one label."""
        return Points(self.frame.filter(F.col("label") == label), self.dims, self.keys)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Small point tables come as one file; pairs are made by all cores only if the rows are spread."""
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism)


def embedding_points(spark: SparkSession, folder: str, dims: int, by_label: bool = False) -> Points:
    """The first `dims` components of all embeddings; a layout for each label, if asked for."""
    features = F.slice(F.col("embedding").cast("array<double>"), 1, dims)
    frame = table(spark, folder, "embeddings").select(*([F.col("label").cast("int").alias("layout")] if by_label else []), F.col("vec_id").cast("long").alias("id"), features.alias("features"), "label")
    return Points(spread(frame), dims, ("layout",) if by_label else ())


def event_series(spark: SparkSession, folder: str) -> DataFrame:
    """layout (the user), id, t in seconds and v of all events; seq numbers each user's events by time from 0."""
    from pyspark.sql import Window

    events = table(spark, folder, "events").select(F.col("user_id").alias("layout"), F.col("event_id").alias("id"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))") / 1e6).alias("t"), F.col("value").alias("v"))
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("layout").orderBy("t", "id")) - 1)


def zipf_degrees(spark: SparkSession, n: int, exponent: float = 2.5, seed: int = 148) -> DataFrame:
    """id and degree: n drawn degrees with a power-law tail, n - 1 at most, with an even sum."""
    drawn = np.minimum(np.random.default_rng(seed).zipf(exponent, n), max(1, n - 1))
    if n and drawn.sum() % 2:
        drawn[0] += 1 if drawn[0] < n - 1 else -1
    return spark.createDataFrame([(i, int(d)) for i, d in enumerate(drawn)], "id long, degree long")


def lognormal_weights(spark: SparkSession, n: int, mean: float = 1.0, deviation: float = 0.5, seed: int = 149) -> DataFrame:
    """id and degree: n drawn expected degrees, for chung_lu."""
    drawn = np.random.default_rng(seed).lognormal(mean, deviation, n)
    return spark.createDataFrame([(i, float(d)) for i, d in enumerate(drawn)], "id long, degree double")


def order_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """id and degree: each customer's number of orders, 0 for those without any."""
    n = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id")).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def gaussian_layout(spark: SparkSession, clusters: list[tuple[int, tuple[float, float], float]], seed: int = 42) -> Points:
    """Clusters of (number of points, centre, deviation), one normal draw for each."""
    rng, rows = np.random.default_rng(seed), []
    for label, (n, centre, deviation) in enumerate(clusters):
        for x, y in rng.normal(centre, deviation, (n, 2)):
            rows.append((len(rows), [float(x), float(y)], label))
    return Points(spark.createDataFrame(rows, "id long, features array<double>, label int"), 2)


def two_cluster_layout(spark: SparkSession, seed: int = 42) -> Points:
    """The canonical 30 points."""
    return gaussian_layout(spark, [(10, (-2.0, 0.0), 0.5), (20, (2.0, 0.0), 0.8)], seed)


def single_cluster_layout(spark: SparkSession, n: int = 30, centre=(0.0, 0.0), deviation: float = 1.0, seed: int = 42) -> Points:
    return gaussian_layout(spark, [(n, centre, deviation)], seed)


def uniform_layout(spark: SparkSession, n: int = 30, xlim=(-4.0, 4.0), ylim=(-3.0, 3.0), seed: int = 42) -> Points:
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(*xlim, n), rng.uniform(*ylim, n)
    return Points(spark.createDataFrame([(i, [float(a), float(b)], 0) for i, (a, b) in enumerate(zip(x, y))], "id long, features array<double>, label int"), 2)


def bounding_box(points: Points, padding: float = 0.5) -> DataFrame:
    x, y = F.get("features", F.lit(0)), F.get("features", F.lit(1))
    return points.frame.groupBy(*points.keys).agg((F.min(x) - padding).alias("x_min"), (F.max(x) + padding).alias("x_max"), (F.min(y) - padding).alias("y_min"), (F.max(y) + padding).alias("y_max"))


def drawn_obstacles(points: Points, n_obstacles: int = 4, radius: float = 0.3, n_vertices: int = 4, seed: int = 42) -> DataFrame:
    """Sides (obstacle, x1, y1, x2, y2) of regular polygons, drawn inside the box of all points. Their size is drawn between
    half of `radius` and `radius`: for four corners half a side, else from the middle to a corner."""
    box = bounding_box(Points(points.frame, points.dims), 0.2).first()
    rng, sides = np.random.default_rng(seed), []
    for number in range(n_obstacles if box["x_min"] is not None else 0):
        middle = [rng.uniform(box[f"{c}_min"] + radius, max(box[f"{c}_min"] + radius, box[f"{c}_max"] - radius)) for c in "xy"]
        turn, size = rng.uniform(0, np.pi / 4), radius * rng.uniform(0.5, 1)
        if n_vertices == 4:
            turn, size = turn + np.pi / 4, size * np.sqrt(2)
        at = turn + 2 * np.pi * np.arange(n_vertices) / n_vertices
        corners = [(float(middle[0] + size * np.cos(a)), float(middle[1] + size * np.sin(a))) for a in at]
        sides += [(number, *a, *b) for a, b in zip(corners, [*corners[1:], corners[0]])]
    return points.frame.sparkSession.createDataFrame(sides, "obstacle int, x1 double, y1 double, x2 double, y2 double")


def spatial_observations(points: Points, n_samples: int = 500, length_scale: float = 1.0, noise_std: float = 0.1, seed: int = 342, most_points: int = 2000) -> DataFrame:
    """id and values: drawn observations of one normal variable for each point (by id), whose covariance falls with the
    squared distance, and noise on top. The covariance is factored on the driver, so more than `most_points` raise; a sample
    is drawn from (seed, id), alike in any partitioning."""
    rows = points.frame.select("id", "features").orderBy("id").limit(most_points + 1).collect()
    if len(rows) > most_points:
        raise ValueError(f"a covariance of at most {most_points} points")
    x, spark = np.array([r["features"] for r in rows], float).reshape(len(rows), -1), points.frame.sparkSession
    squares = ((x[:, None] - x[None]) ** 2).sum(-1)
    covariance = nearest_positive_definite(np.exp(-squares / (2 * length_scale**2)) + noise_std**2 * np.eye(len(x)))
    factor = np.linalg.cholesky(covariance)

    def draw(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "values": [factor @ np.random.default_rng([seed, i]).standard_normal(len(factor)) for i in pdf["id"]]})

    return spark.range(n_samples).mapInPandas(draw, "id long, values array<double>")


def nonlinear_observations(observations: DataFrame, nonlinearity: str = "square") -> DataFrame:
    """Observations with some variables bent, so that they depend on others without being correlated: every second one
    squared (`square`) or put through sin(pi x) (`sin`), every third without its sign (`abs`), or in turn
    squared, without sign, through the sine, and as it is (`mixed`)."""
    bent = {"square": lambda x: x * x, "abs": F.abs, "sin": lambda x: F.sin(np.pi * x)}
    turns = {"square": ["square", None], "abs": ["abs", None, None], "sin": ["sin", None], "mixed": ["square", "abs", "sin", None]}
    if nonlinearity not in turns:
        raise ValueError(f"unknown nonlinearity {nonlinearity}")
    row = turns[nonlinearity]

    def each(x, k):
        out = x
        for place, name in enumerate(row):
            if name:
                out = F.when(k % len(row) == place, bent[name](x)).otherwise(out)
        return out

    return observations.withColumn("values", F.transform("values", each))
