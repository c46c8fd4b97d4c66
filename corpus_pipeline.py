"""A corpus pipeline of five stages, each on what the stage before it has kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next one's docs. run() does so in the folder that the executors share.

All stages tell documents apart by row: nulls in any column, empty and very long texts, ids that are null or repeat, and
empty tables go through as each stage's docstring says; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from weft.llm import decontaminate, minhash, queries, secrets, sentencepiece_bpe
from weft.llm.common import Scratch, small_batches, table
from weft.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7. The field is fitted on labelled rows of `docs`. Null and empty texts have the score
    of no toxic word; rows that repeat are judged alike; without labels of both kinds all have the score of the only kind."""
    return without_toxic(docs, queries.toxic_field(spark, docs, sf_dir), 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group (runs of five words, similarity 0.8 or more): that with the smallest id, null ids last, then the
    smallest key of its text; of rows that repeat both one. Rows without words all stay."""
    return minhash.without_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no test item, each judged by its own text, whatever its id."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text replaced by their kind; null texts stay null."""
    return secrets.redact_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids with an end id, and the text that they decode to; null and empty texts have the end id alone."""
    return sentencepiece_bpe.sentencepiece_round_trip(docs, queries.sentencepiece_model())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_redaction", secret_redaction), ("encoding", encoding)]

#: The field's training and the encoding can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        kept = scratch.cut(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = kept
    return docs
