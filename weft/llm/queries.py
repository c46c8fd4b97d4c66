"""The queries opN_<name> and pipeline, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, line_rules, minhash, oracles, quality, secrets, sentencepiece_bpe, sharding, toxicity, url_filters
from .common import small_batches, table
from .labelled import held_out, labelled_sample

#: Rows of each label that a classifier is fitted on, at most.
TOXIC_SAMPLE = {1: 500, 0: 2000}
QUALITY_SAMPLE = {1: 1500, 0: 1500}


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.sentencepiece_digest(sentencepiece_bpe.sentencepiece_round_trip(table(spark, sf_dir, "documents"), sentencepiece_model()))


def sentencepiece_model() -> bytes:
    import public_tokenizers

    return sentencepiece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def toxic_field(spark: SparkSession, documents: DataFrame, sf_dir: str) -> toxicity.ToxicField:
    return toxicity.ToxicField().fit(*labelled_sample(documents, table(spark, sf_dir, "labels"), "toxic", 3, 1, TOXIC_SAMPLE))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(documents, toxic_field(spark, documents, sf_dir))
    offsets = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_toxic_words"), offsets.alias("toxic_offsets"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.rule_digest(line_rules.line_first_cleaning(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    ranker = quality.PairwiseRanker().fit(*labelled_sample(documents, table(spark, sf_dir, "labels"), "quality", 5, 0, QUALITY_SAMPLE))
    scored = quality.score_quality(documents, ranker)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_filters.RULES), "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def _bounded(query):
    """The query, in a session whose batches of whole texts are small."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = (op1_licenses, op2_sentencepiece, op3_toxicity, op4_sharding, op5_line_rules, op6_quality, op7_url_filters, op8_minhash, op9_decontaminate, op10_secrets)
    return {f.__name__: _bounded(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": oracles.OP4, "op5_line_rules": oracles.OP5, "op7_url_filters": oracles.OP7, "op8_minhash": oracles.OP8, "op10_secrets": oracles.OP10}
