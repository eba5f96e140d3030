"""Retrieval metrics over rankings (query_id, doc_id, rank) and relevance (query_id, doc_id, gain)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def retrieval_metrics(ranking: DataFrame, relevance: DataFrame, k: int, empty: str = "null") -> DataFrame:
    """Per query: recall, precision, hit, reciprocal rank and nDCG at k.

    A document ranked twice counts once, at its best rank; a query without relevant documents has null
    (empty="null") or zero recall and nDCG; gains are linear, discounted by log2(rank + 1).
    """
    once = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).filter(F.col("rank") <= k)
    gold = relevance.filter("gain > 0").groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"))
    ideal = gold.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1))).alias("idcg"))
    hits = once.join(gold, ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.count("*").alias("n_hit"), F.min("rank").alias("first_rank"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    asked = ranking.select("query_id").distinct()
    none = F.lit(None).cast("double") if empty == "null" else F.lit(0.0)
    joined = asked.join(ideal, "query_id", "left").join(hits, "query_id", "left")
    share = lambda a, b: F.when(F.col("n_gold").isNull(), none).otherwise(F.round(F.coalesce(a, F.lit(0)) / b, 6))
    return joined.select(
        "query_id", share(F.col("n_hit"), F.col("n_gold")).alias("recall"), F.round(F.coalesce("n_hit", F.lit(0)) / k, 6).alias("precision"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("hit"), F.coalesce(F.round(1 / F.col("first_rank"), 6), F.lit(0.0)).alias("reciprocal_rank"),
        share(F.col("dcg"), F.col("idcg")).alias("ndcg"), F.col("first_rank").cast("bigint").alias("first_rank"),
    )


def counted_metrics(ranking: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """As retrieval_metrics where documents are relevant or not and only their number is known.

    ranking: query_id, doc_id, rank, relevant (each document once); sizes: query_id, n_gold. What is
    relevant but not ranked never has to be listed.
    """
    gain = F.when(F.col("relevant") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1))
    hits = ranking.groupBy("query_id").agg(F.count(gain).alias("n_hit"), F.min(F.when(gain.isNotNull(), F.col("rank"))).alias("first_rank"), F.sum(gain).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    n = F.coalesce(F.col("n_gold"), F.lit(0))
    joined = hits.join(sizes, "query_id", "left")
    return joined.select(
        "query_id", F.when(n > 0, F.round(F.col("n_hit") / n, 6)).alias("recall"), F.round(F.col("n_hit") / k, 6).alias("precision"), (F.col("n_hit") > 0).alias("hit"),
        F.coalesce(F.round(1 / F.col("first_rank"), 6), F.lit(0.0)).alias("reciprocal_rank"), F.when(n > 0, F.round(F.coalesce("dcg", F.lit(0.0)) / best, 6)).alias("ndcg"), F.col("first_rank").cast("bigint").alias("first_rank"),
    )


def evidence_recall(ranking: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """groups: query_id, evidence_id, doc_id: an evidence is found with any of its documents in the
    first k. Result: query_id, evidence_recall, all_evidence."""
    top = ranking.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")).distinct()
    each = groups.join(top, ["query_id", "doc_id"], "left").groupBy("query_id", "evidence_id").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    return each.groupBy("query_id").agg(F.round(F.avg("hit"), 6).alias("evidence_recall"), (F.min("hit") == 1).alias("all_evidence"))


def overlap_at(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of the first k of a ranking that are among the first k of another, per query."""
    both = a.filter(F.col("rank") <= k).select("query_id", "doc_id").join(b.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("in_b")), ["query_id", "doc_id"], "left")
    return both.groupBy("query_id").agg(F.round(F.count("in_b") / F.lit(k), 6).alias("overlap"))
