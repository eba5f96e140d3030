"""Rankings in long form (query_id, method, doc_id, score, rank): top-k, fusion and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernlake.session import cut


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, salt_by: str, salts: int = 64, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank. Keys may hold any share of the rows: each is cut
    down to k rows per salt first, so no task sees a whole one."""
    part = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    part = part.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_r") <= k)
    return part.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k).drop("_salt", "_r")


def numbered(df: DataFrame, order: list[Column], column: str = "rank") -> DataFrame:
    """All rows numbered from 1 in one total order without one task seeing them all: ranges are written,
    numbered apart and moved by the sizes of those before them (a row a range is sent everywhere)."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    within = parts.withColumn("_r", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return within.join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + F.col("_r")).drop("_part", "_before", "_r")


def reciprocal_rank_fusion(lists: DataFrame, c: int = 60, tie: str = "id") -> DataFrame:
    """Sum of 1 / (c + rank) over the methods that list a document; a document a method lists twice
    counts with its best rank. Ties go by id, by the best rank or by the number of methods, then by id.

    Result: query_id, doc_id, score (9 digits), n_methods, best_rank, rank.
    """
    once = lists.groupBy("query_id", "method", "doc_id").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1 / (F.lit(c) + F.col("rank"))), 9).alias("score"), F.count("*").alias("n_methods"), F.min("rank").alias("best_rank")
    )
    by = {"id": [], "min_rank": [F.col("best_rank")], "list_count": [F.desc("n_methods")]}[tie]
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), *by, "doc_id")))


def min_max_fusion(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of each method's scores scaled to 0..1 per query; equal scores count 1, missing ones 0."""
    w = W.partitionBy("query_id", "method")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = lists.withColumn("scaled", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    fused = scaled.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("scaled") * F.coalesce(F.try_element_at(weight, F.col("method")), F.lit(0.0))), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def candidate_pool(lists: DataFrame, methods: list[str]) -> DataFrame:
    """Each listed document with its rank by every method (null where it isn't listed)."""
    return lists.groupBy("query_id", "doc_id").agg(*(F.min(F.when(F.col("method") == m, F.col("rank"))).alias(f"rank_{m}") for m in methods))


def collapse(lists: DataFrame, group: Column) -> DataFrame:
    """A ranking of groups by the first of their members, ranked anew."""
    best = lists.groupBy("query_id", "method", group.alias("group_id")).agg(F.min("rank").alias("best_rank"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "method").orderBy("best_rank", "group_id")))


def append_ranked(seeds: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """The seeds in their order, then documents of `more` that are no seeds, up to `limit`."""
    both = seeds.select("query_id", "doc_id", F.lit(0).alias("stage"), "rank").unionByName(more.select("query_id", "doc_id", F.lit(1).alias("stage"), "rank"))
    first = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("stage", "rank")).alias("at"))
    placed = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("at.stage", "at.rank", "doc_id")))
    return placed.filter(F.col("rank") <= limit).select("query_id", "doc_id", F.col("at.stage").alias("stage"), "rank")


def pack_truncated(items: DataFrame, budget: int, length: str = "length") -> DataFrame:
    """Items by rank into a budget: whole while they fit, the first that doesn't is cut, the rest is out."""
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(length).over(w), F.lit(0))
    kept = F.greatest(F.lit(0), F.least(F.col(length).cast("bigint"), F.lit(budget) - before))
    state = F.when(kept == F.col(length), "whole").when(kept > 0, "cut").otherwise("out")
    return items.withColumn("kept", kept).withColumn("state", state)


def pack_skipping(items: DataFrame, budget: int, length: str = "length") -> DataFrame:
    """Items by rank into a budget, passing over those that no longer fit; whether one is in depends on
    those before it, so the bounded list of a query is folded in one expression."""
    listed = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.col(length).cast("bigint").alias("length")))).alias("l"))
    empty = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(items.select(F.array("doc_id")).schema[0].dataType).alias("ids"))
    folded = F.aggregate(
        "l", empty,
        lambda a, x: F.when(a["used"] + x["length"] <= budget, F.struct((a["used"] + x["length"]).alias("used"), F.array_append(a["ids"], x["doc_id"]).alias("ids"))).otherwise(a),
    )
    return listed.select("query_id", folded.alias("f")).select("query_id", F.posexplode("f.ids").alias("position", "doc_id"), F.col("f.used").alias("used"))
