"""Queries of the text operators with production parameters, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, delta_lloyd, fill_in_middle, line_dedup, lm_scoring, mixing, near_duplicates, quality_model, robust_rules, sharding, simhash, substring_dedup, url_rules
from tidemark.sources.paths import fresh

#: Parts of the mix by source; all other sources share one part.
MIX = {"src0": 6, "src1": 4, "src2": 4, "src3": 3, "src4": 3, "src5": 2, "src6": 2, "src7": 2, "src8": 2, "src9": 2, mixing.REST: 10}
MIX_BLOCK = 65_536  # characters

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Listed hosts: each of these names under each of these domains, with all that is below them.
URL_LIST_NAMES = ("spam-farm", "cheap-pills", "adult-x", "casino-win", "free-bets", "ads-track")
URL_LIST_DOMAINS = ("example.com", "example.net", "example.org")
#: Besides, this many pages by rule: page k is /listed/k on host k mod 1000, as a list holds mostly what a crawl never meets.
URL_LIST_PAGES = 20_000


def url_list(spark: SparkSession) -> DataFrame:
    """host, path of the blocked URLs."""
    hosts = [(f"{n}.{d}", "") for n in URL_LIST_NAMES for d in URL_LIST_DOMAINS]
    k = F.col("id")
    pages = spark.range(URL_LIST_PAGES).select(F.concat(F.lit("host"), k % 1000, F.lit(".example.com")).alias("host"), F.concat(F.lit("/listed/"), k).alias("path"))
    return spark.createDataFrame(hosts, "host string, path string").unionByName(pages)


SHARDS = sharding.Tiers(arrival_rows=2_000, target_bytes=64 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_terms", F.round("log_score", 4).alias("log_score"), F.round("mean_log", 6).alias("mean_log"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.judge(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.judge(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def sharded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, shard (its place in the manifest), rows and bytes of the shard, tier and version, from written shards."""
    store = sharding.ShardTable(spark, fresh(spark, "shards"), SHARDS)
    store.append(docs)
    version = store.compact()
    store.vacuum()
    shards = store.manifest(version).select("file", "bytes", "rows", "seq", "tier")
    return store.read(version, with_shard="shard_file").select("doc_id", F.col("shard_file").alias("file")).join(shards, "file").select("doc_id", F.col("seq").alias("shard"), "rows", "bytes", "tier", F.lit(version).alias("version"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark, table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"), MIX, MIX_BLOCK)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.judge(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules, url_list(spark))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.judge(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.judge(table(spark, sf_dir, "documents"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.judge(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_near_duplicates,
        op3_substring_dedup,
        op4_quality_classifier,
        op5_sharding,
        op6_mixing,
        op7_line_dedup,
        op8_decontamination,
        op9_url_filter,
        op10_quality_rules,
        op11_simhash,
        op12_fill_in_middle,
        op13_delta_lloyd,
    )
}
