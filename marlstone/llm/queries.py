"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, conversations, importance, mixing, ngram_join, pieces, quality_rules, repeats, sharding, surrogates, token_counts, toxicity, warc
from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove(table(spark, sf_dir, "documents")))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.read(warc.write(table(spark, sf_dir, "pages"))))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "text", "cast(size(entities) as long) as n_entities", "entities")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.repair(conversations.damage(table(spark, sf_dir, "conversations"))))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), token_counts.model_file("byte_bpe_50k.json"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_join, op2_quality_rules, op3_toxicity, op4_repeats, op5_nearest, op6_sharding, op7_mixing, op8_warc, op9_surrogates, op10_pieces, op11_conversations, op12_token_counts, op13_importance)
}
SQL: dict[str, str] = {"op2_quality_rules": quality_rules.SQL, "op7_mixing": mixing.SQL, "op8_warc": warc.SQL, "op11_conversations": conversations.SQL, "op13_importance": importance.SQL}
