"""The operators of this package as queries over one folder of tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.llm import bestfit, decontamination, language, lines, negatives, packing, quality, sharding, similarity, spelling, topk, toxicity, urls
from merchlake.llm.common import crc32_text
from merchlake.llm.sql import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function: Callable) -> Callable:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = packing.pack(_table(spark, folder, "documents"), *files, length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    rows = _table(spark, folder, "documents").select("doc_id", size.alias("size"), crc32_text(F.col("text")).alias("text_crc32"))
    placed = sharding.shard(rows, 24, ties=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _remainder(divisor: int):
    return F.coalesce(crc32_text(F.col("doc_id")), F.lit(0)) % divisor


@_query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = quality.fit(docs, labels, _remainder(5) != 0)
    scored = docs.select("doc_id", (_remainder(5) == 0).alias("held_out"), quality.scorer(model, spark)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@_query
def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge(_table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("log_odds", 6).alias("log_odds"))


@_query
def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.classes(_table(spark, folder, "documents"), words_each=3, percent=90)


@_query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    predict = language.predictor(language.fit(docs, _remainder(4) != 2))
    found = docs.select("doc_id", (_remainder(4) == 2).alias("held_out"), predict("text").alias("_p"))
    return found.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), "_p.score")


@_query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    model = toxicity.fit(docs, labels, _remainder(3) != 1)
    found = docs.select("doc_id", (_remainder(3) == 1).alias("held_out"), toxicity.scorer(model, spark)("text").alias("_s"))
    return found.select("doc_id", "held_out", "_s.score", (F.col("_s.score") >= 0.7).cast("int").alias("predicted"),
                        F.size("_s.passages").alias("n_passages"))


@_query
def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    share = F.round(F.col("covered") / F.col("words"), 6)
    return found.select("doc_id", "item_id", "covered", share.alias("coverage"), F.size("tiles").alias("n_tiles"))


@_query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.dedupe(_table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "lines_removed", F.length("text").cast("bigint").alias("chars_left"), crc32_text(F.col("text")).alias("text_crc32"))


@_query
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, noisy)


@_query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


@_query
def op12_bestfit(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = bestfit.pack(_table(spark, folder, "documents"), *files, length=1024, end_id=2)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
