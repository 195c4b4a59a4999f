"""Registered queries of this package: name -> callable(spark, sf_dir). None of them has a plain SQL twin (see README)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import defects, entity_matching, format_duplicates, leak_free_splits, mixture, packing, pairwise_ranking, reading_level


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, comps = leak_free_splits.project(spark, sf_dir)
    out = leak_free_splits.separated(records.where("record_table = 'features_labeled'"), comps)
    return out.select(F.col("record_id").alias("feature_id"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, comps = leak_free_splits.project(spark, sf_dir)
    return leak_free_splits.assign(records, comps)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_matching.project(spark, sf_dir).select("completion_id", "row_id", "side").distinct()


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_matching.project(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = format_duplicates.groups(spark, sf_dir)
    return g.where("id <> first_id").select("record_table", "first_id", F.col("id").alias("other_id"))


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = format_duplicates.groups(spark, sf_dir)
    return g.where("id = first_id").select("record_table", "first_id", "copies")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.project(spark, sf_dir).where("nth = 1").select("row_id", "side", "defect")


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.project(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_ranking.project(spark, sf_dir).where("rank <= 8").select("item_id")


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_ranking.project(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.project(spark, sf_dir).where("piece > 0").select("doc_id").distinct()


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.project(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    c = packing.project(spark, sf_dir).where("container_id is not null").groupBy("container_id").agg(F.sum("length").alias("used"), F.count("*").alias("items"))
    return c.groupBy((F.lit(packing.CAPACITY) - F.col("used")).alias("unused_tokens")).agg(F.count("*").alias("containers"), F.sum("items").alias("items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, allocation = mixture.project(spark, sf_dir)
    return allocation.where("short").select("source")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, allocation = mixture.project(spark, sf_dir)
    return mixture.report(mixture.select(docs, allocation), allocation)


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, allocation = mixture.project(spark, sf_dir)
    return mixture.select(docs, allocation)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.project(spark, sf_dir).select("doc_id", "level")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.project(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
