"""Cutting lineage in loops: tables written under the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else the context's checkpoint folder. Where neither is set: a temporary
    folder if all runs in this process's machine (local master), and the warehouse on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not context.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="weft-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written once and read again. The table is deleted when the application ends."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/weft-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): the least node that each node reaches, by least labels with shortcuts."""
    from pyspark.sql import functions as F

    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("best"), F.col("label").alias("was"))
        over = labels.select(F.col("node").alias("best"), F.col("label").alias("further"))
        fresh = cut(step.join(over, "best").select("node", F.least("best", "further").alias("label"), "was"))
        if not fresh.filter("label < was").limit(1).count():
            return fresh.select("node", "label")
        labels = fresh.select("node", "label")
