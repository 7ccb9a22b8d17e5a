"""Registered queries of the problems on records, vectors and texts (p6 to p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import join_group_facts, positions
from ..sources.tables import table
from . import bisect, mixing, refine, toxic, winnow
from .sql import SQL  # noqa: F401


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return refine.duplicate_pairs(table(spark, d, "edge_records"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return refine.collapsed_records(table(spark, d, "edge_records"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "zip_embeddings").select("zip", *[f"e{i}" for i in range(8)])
    return bisect.clusters(bisect.usable_vectors(vectors))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).filter("zip > cluster").select(F.col("cluster").alias("cluster_zip"), "zip").distinct()


def p7_units(spark: SparkSession, d: str) -> DataFrame:
    members = _clusters(spark, d).select("zip", "cluster").distinct()
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    numbered = sizes.join(positions(sizes, "cluster", "unit_id"), "cluster")
    return join_group_facts(members, numbered, "cluster", "_n", members.count()).select("zip", "unit_id")


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return bisect.describe(_clusters(spark, d)).select("cluster", "size", "typical_1", "typical_2", "typical_3")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return winnow.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", "kind")
    counts = p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.join(counts, "item_id", "left").select("item_id", "kind", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    shares = mixing.plan(mixing.sizes(documents), table(spark, d, "mix_targets"))
    return mixing.mixture(documents, shares)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.sizes(table(spark, d, "documents"))
    return mixing.shares_report(sized, mixing.plan(sized, table(spark, d, "mix_targets")))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    documents, p = table(spark, d, "documents"), toxic.ToxicParams()
    model = toxic.fit(documents, table(spark, d, "doc_labels"), table(spark, d, "flag_terms"), p)
    return toxic.score_documents(documents, model, p)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).filter(F.col("score") >= toxic.ToxicParams().threshold).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    flagged = F.sum((F.col("score") >= toxic.ToxicParams().threshold).cast("bigint"))
    scored = _scores(spark, d).withColumn("source", F.coalesce(mixing.plain_source(F.col("source")), F.lit("")))
    rates = scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), flagged.alias("n_flagged"))
    return rates.withColumn("rate", F.col("n_flagged") / F.col("n_docs"))


QUERIES = {f.__name__: f for f in (p6_found, p6_records, p7_found, p7_units, p7_summary, p8_found, p8_items, p9_mixture, p9_shares, p10_found, p10_scores, p10_rates)}
