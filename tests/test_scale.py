"""Grid search for nearest neighbours, and the stream, against the plain forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from weft.operators.visibility import horizontal_visibility
from weft.plans.pairs import nearest
from weft.sources.tables import Points
from weft.streaming.visibility import stream_horizontal_visibility


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_grid_nearest(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(size=(150, dims)), rng.normal(size=(5, dims)) * 40])  # a few far ones
    frame = spark.createDataFrame([(i % 2, i, row.tolist(), 0) for i, row in enumerate(x)], "layout int, id long, features array<double>, label int")
    for p in (Points(frame.drop("layout"), dims), Points(frame, dims, ("layout",))):
        names = [*p.keys, "src", "dst", "rank"]
        assert {tuple(r[n] for n in names) for r in nearest(p, 4, grid_from=10).collect()} == {tuple(r[n] for n in names) for r in nearest(p, 4).collect()}


def test_stream(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(u, 100 * u + i, float(i), float(rng.integers(0, 6))) for u in range(3) for i in range(30)]
    frame = pd.DataFrame(rows, columns=["layout", "id", "t", "v"])
    (tmp_path / "in").mkdir()
    kind = "layout long, id long, t double, v double"
    stream = stream_horizontal_visibility(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    frame[frame.t < 11].sample(frac=1, random_state=1).to_parquet(tmp_path / "in" / "a.parquet")
    query = stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    frame[frame.t >= 11].to_parquet(tmp_path / "in" / "b.parquet")
    query.processAllAvailable()
    query.stop()
    series = spark.createDataFrame(rows, kind).withColumn("seq", F.col("t").cast("int"))
    key = lambda r: (r["layout"], r["src"], r["dst"], r["weight"], r["time_gap"])
    assert sorted(map(key, spark.table("seen").collect())) == sorted(map(key, horizontal_visibility(series).collect()))
