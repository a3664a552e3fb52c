"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reprolens.llm import embed_dedup, jaccard, media, mixing, packing, pii, quality, quotes, resharding, substring_dedup
from reprolens.llm.common import documents


def op1_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(spark, documents(spark, sf_dir))


def op2_media_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(documents(spark, sf_dir))


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir))


def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_collision_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(spark, documents(spark, sf_dir))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(spark, documents(spark, sf_dir))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.digest(spark, documents(spark, sf_dir))


def op10_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(spark, documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_crf_pii, op2_media_containers, op3_mixture_packing, op4_quality_qda, op5_collision_embeddings, op6_debruijn_substrings, op7_pareto_mixing, op8_quotation_linking, op9_flow_resharding, op10_multi_order_jaccard)
}
ORACLES: dict[str, str] = {"op5_collision_embeddings": embed_dedup.ORACLE, "op6_debruijn_substrings": substring_dedup.ORACLE, "op7_pareto_mixing": mixing.ORACLE, "op8_quotation_linking": quotes.ORACLE, "op10_multi_order_jaccard": jaccard.ORACLE}
