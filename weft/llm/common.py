"""What the operators of this subpackage share: reading, cutting lineage, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
PART_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; the path may be of any file system that Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
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


class Scratch:
    """Tables written under the shared folder, which any executor can read again after another is lost. They are
    deleted with drop() and drop_others(), and the rest when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)  # what is left when the application ends

    def cut(self, frame: DataFrame) -> DataFrame:
        """Write a frame once and go on from the written table, without its lineage."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._weft_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._weft_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_others(self, kept: DataFrame) -> None:
        """Delete all tables but one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        system = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in range(1, self.n + 1):
            if f"{self.root}/{n}" != kept._weft_path:
                system.delete(path(f"{self.root}/{n}"), True)


def map_arrow(frame: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state that each task makes once. Batches are as the session cuts them; a batch goes to
    `each` in parts of about 4 MB (or one row, where that is longer), which bounds what is made of it at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                step = max(1, batch.num_rows * PART_BYTES // max(PART_BYTES, batch.nbytes))
                for low in range(0, batch.num_rows, step):
                    yield from each(batch.slice(low, step))
        del each
        give_back()

    return frame.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """For an application that maps whole texts: batches of at most 8 MB between the JVM and Python workers, where the
    session has Spark's own limit. Operators leave the session as it is; the registered queries call this."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "8m")


def give_back() -> None:
    """Return what a task has freed to the system: a worker that waits for its next task shall be small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def small_enough(frame: DataFrame, most_rows: int) -> bool:
    """Whether a frame has at most so many rows; reads no more than needed to tell."""
    return frame.limit(most_rows + 1).count() <= most_rows


def hot_keys(frame: DataFrame, key: str, count: str | None = None, least: int = 1000, parts: int = 4096) -> DataFrame | None:
    """The values of `key` that more than one of `parts` parts of all rows have (and more than `least` rows): fewer than
    `parts` values, whatever the input. None where there can't be any. count: a column of `frame` that already counts the rows of its key."""
    total = (frame.agg(F.count("*")) if count is None else frame.agg(F.sum(count))).first()[0] or 0
    if total <= least:
        return None
    counts = frame.groupBy(key).agg(F.count("*").alias("weft_n")) if count is None else frame.select(key, F.col(count).alias("weft_n"))
    return counts.filter(F.col("weft_n") > max(least, total // parts)).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: DataFrame | None, salts: int = 64) -> DataFrame:
    """Inner join on `key`, where `right` has few rows for a key and `left` may have very many: rows of the hot keys are dealt to
    `salts` parts by the hash of `by`, and those of `right` are repeated for each."""
    if hot is None:
        return left.join(right, key)
    hot = F.broadcast(hot.select(F.col(key), F.lit(True).alias("weft_hot")))
    dealt = left.join(hot, key, "left").withColumn("weft_salt", F.when(F.col("weft_hot"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0)).drop("weft_hot")
    copies = F.when(F.col("weft_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.join(hot, key, "left").withColumn("weft_salt", F.explode(copies)).drop("weft_hot"), [key, "weft_salt"]).drop("weft_salt")


def components_in_one_task(edges: DataFrame) -> DataFrame:
    """(node, label) for a number of edges (a, b) that one task may hold: union-find."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        top: dict[int, int] = {}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            for x in (a, b):
                top.setdefault(x, x)
            while top[a] != a:
                top[a] = a = top[top[a]]
            while top[b] != b:
                top[b] = b = top[top[b]]
            top[max(a, b)] = min(a, b)
        labels = []
        for x in top:
            while top[x] != x:
                x = top[x]
            labels.append(x)
        return pd.DataFrame({"node": list(top), "label": labels}, dtype="int64")

    return edges.select("a", "b", F.lit(0).alias("all")).groupBy("all").applyInPandas(find, "node long, label long")


def crc32_of_id(column: Column) -> Column:
    """crc32 of an id's decimal text."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))
