"""URL filters: a blocked Bloom filter before an exact hash join.

Listed URLs are canonical: host in lower case (A-Z), then the path's beginning. A page asks for all
keys that could be listed: each of its host's suffixes, up to as many labels as a listed host has, with each beginning of
its path that is as long as a listed path. A key's hash picks one block of 256 bits (four longs) and one bit in each of its
longs; keys whose four bits are all set are possible hits, and a join on the key itself removes those
that aren't listed. Of the rules that fit, the longest wins, and of equally long ones that with the
longer host; pages without a rule get `default`.

A list of at most `small` keys, whose pages ask for `most_asked` keys each at most, is judged row by row, without a shuffle:
the filter's blocks and the list's hash table (an array of small maps) are two scalar values that all tasks get, about 2 and
100 bytes to a key, and a key is looked for in its block and its bucket. Other lists are joined by shuffle: distinct (host, path) ask for their keys, the filter's blocks are
joined by number, what is left by key, and the best rule goes back to the pages.

Defined results: null URLs and those without "://" have an empty host and path and fit no rule. Repeated pages give
repeated results, null ids stay null, an empty table gives an empty result, an empty list lets all pages have `default`. A key
that is listed twice has the smallest verdict. Columns other than page_id and url are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Host, path and verdict of each rule of the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def bloom_bits(h: Column) -> list[Column]:
    """For each long of a block the bit of a key's hash."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 8 + 6 * k), F.lit(64)).cast("int")) for k in range(4)]


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks).cast("long"))


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """block, and its longs w0 to w3, of the column `key`."""
    hashed = keys.select(F.xxhash64("key").alias("h"))
    return hashed.groupBy(block_of(F.col("h"), blocks).alias("block")).agg(*(F.bit_or(bit).alias(f"w{k}") for k, bit in enumerate(bloom_bits(F.col("h")))))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", small: int = 100_000, most_asked: int = 64) -> DataFrame:
    """page_id, host, path, rule and verdict. rules: host, path, verdict."""
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    listed = rules.select(F.concat("host", F.lit("\n"), "path").alias("key"), "host", "path", "verdict").filter("key is not null").groupBy("key", "host", "path").agg(F.min("verdict").alias("verdict"))
    listed = Scratch(pages.sparkSession).cut(listed)
    size = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("host", "\\."))).alias("depth")).first()
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect()) or [0]  # as many as the longest URL has characters, at most
    depth, labels = size["depth"] or 1, F.split("host", "\\.")
    suffix = lambda i: F.when(F.size(labels) >= i, F.array_join(F.slice(labels, -i, i), "."))
    begin = lambda k: F.when(F.length("path") >= k, F.substring("path", 1, k))
    keys = [F.concat(suffix(i), F.lit("\n"), begin(k)) for i in range(1, depth + 1) for k in lengths]  # null: no such key
    judge = _judge_in_rows if size["n"] <= small and len(keys) <= most_asked else _judge_by_joins
    return judge(parts, listed, size["n"], keys).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _rule(host: Column, path: Column, verdict: Column) -> Column:
    """A rule in the order by which the best is the largest."""
    return F.struct((F.length(host) + F.length(path)).alias("n"), F.length(host).alias("m"), F.concat(host, path).alias("rule"), verdict.alias("verdict"))


def _in_order(frame: DataFrame, n: int, place: str, values: list[str]) -> Column:
    """A scalar: the array over places 0 to n - 1 of a frame's values, null where there is none."""
    all_places = frame.sparkSession.range(n).withColumnRenamed("id", place).join(frame, place, "left")
    return all_places.groupBy().agg(F.sort_array(F.collect_list(F.struct(place, *values))).alias("a")).scalar()


def _judge_in_rows(parts: DataFrame, listed: DataFrame, n: int, keys: list[Column]) -> DataFrame:
    """parts with the best rule, by lookups in scalars."""
    blocks, buckets = max(1, math.ceil(n * 10 / 256)), max(1, n)
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(buckets).cast("long"))
    bloom = _in_order(blocked_bloom(listed, blocks), blocks, "block", ["w0", "w1", "w2", "w3"])
    entry = F.struct("key", _rule(F.col("host"), F.col("path"), F.col("verdict")).alias("best"))
    held = listed.groupBy(place(F.col("key")).alias("bucket")).agg(F.map_from_entries(F.collect_list(entry)).alias("rules"))
    table = held.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(held, "bucket", "left")
    table = table.groupBy().agg(F.array_sort(F.collect_list(F.struct("bucket", "rules")), lambda x, y: (x["bucket"] - y["bucket"]).cast("int")).alias("a")).scalar()

    def rule_of(key: Column) -> Column:
        h = F.xxhash64(key)
        block, possible = F.get(bloom, block_of(h, blocks).cast("int")), key.isNotNull()
        for k, bit in enumerate(bloom_bits(h)):
            possible = possible & (F.coalesce(block[f"w{k}"], F.lit(0)).bitwiseAND(bit) != 0)
        return F.when(possible, F.try_element_at(F.get(table, place(key).cast("int"))["rules"], key))

    return parts.withColumn("best", F.array_max(F.array(*map(rule_of, keys))))


def _judge_by_joins(parts: DataFrame, listed: DataFrame, n: int, keys: list[Column]) -> DataFrame:
    """parts with the best rule, by shuffles; pages without a host ask for nothing."""
    blocks = max(1, math.ceil(n * 10 / 256))
    asked = parts.filter("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(F.array(*keys)).alias("key")).filter("key is not null")
    asked = asked.withColumn("weft_h", F.xxhash64("key"))
    possible = asked.withColumn("block", block_of(F.col("weft_h"), blocks)).join(blocked_bloom(listed, blocks), "block")
    for k, bit in enumerate(bloom_bits(F.col("weft_h"))):
        possible = possible.filter(F.col(f"w{k}").bitwiseAND(bit) != 0)
    rules = listed.select("key", _rule(F.col("host"), F.col("path"), F.col("verdict")).alias("best"))
    hits = possible.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "key").join(rules, "key")
    best = hits.groupBy("of_host", "of_path").agg(F.max("best").alias("best"))
    return parts.join(best, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
