"""A bounded, repeatable sample of labelled texts for fitting, and held-out marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(crc32_of_id(doc_id) % parts == part, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, name: str, parts: int, part: int, most: dict[int, int]) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of at most `most[label]` documents of each label that aren't held out, those of the smallest hashes; and how
    many such documents there are of each label. Labels other than those of `most` don't count; an id with several labels
    has the largest, and one with several texts the smallest. sum(most.values()) ids are joined by broadcast, at most,
    and as many texts come to the driver."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(name).isin(*most) & ~held_out(F.col("doc_id"), parts, part))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(name).cast("int").alias("weft_label"))
    counts = {r["weft_label"]: r["count"] for r in known.groupBy("weft_label").count().collect()}
    picked = None
    for label, n in most.items():
        some = known.filter(F.col("weft_label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.unionByName(some)
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("weft_text")).join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id", "weft_label").agg(F.min("weft_text").alias("weft_text")).collect()
    return [(r["weft_text"], r["weft_label"]) for r in sorted(rows, key=lambda r: r["doc_id"])], counts
