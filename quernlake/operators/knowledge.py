"""Building, validating and merging a graph of entities, edges and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernlake.functions.text import squeeze


def stable_id(*parts: Column, width: int = 24) -> Column:
    """Id from the hash of parts; a separator that no text holds keeps them apart."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, width)


def first_of(df: DataFrame, key: list[str], by: str) -> DataFrame:
    """The row of each key with the smallest `by`: an aggregation, so copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), by).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def latest_of(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def canonical_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, canonical: the smallest key of those whose text is the same but for whitespace."""
    hashed = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.sha2(squeeze(F.col(text)), 256).alias("h"))
    return hashed.join(hashed.groupBy("h").agg(F.min("key").alias("canonical")), "h").select("key", "canonical")


def upsert(target: DataFrame, changes: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """The target after inserting the changes; rows of a known key are replaced or left as they are."""
    if update:
        return target.join(changes.select(*key), key, "left_anti").unionByName(changes)
    return target.unionByName(changes.join(target.select(*key), key, "left_anti"))


def validate_triples(triples: DataFrame, entities: DataFrame, schema: DataFrame, texts: DataFrame) -> DataFrame:
    """The first reason for which a triple fails, or null.

    triples: edge_id, subject, predicate, object, chunk_id, evidence. entities: entity_id, entity_type
    (distinct). schema: predicate, domain, range, a row per allowed pair; a bounded list. texts:
    chunk_id, text. Order of reasons: unknown_predicate, dangling_subject, dangling_object,
    evidence_not_found, domain_mismatch, range_mismatch.
    """
    rules = schema.groupBy("predicate").agg(F.collect_set("domain").alias("domains"), F.collect_set("range").alias("ranges"))
    s = entities.select(F.col("entity_id").alias("subject"), F.col("entity_type").alias("s_type"))
    o = entities.select(F.col("entity_id").alias("object"), F.col("entity_type").alias("o_type"))
    j = triples.join(F.broadcast(rules), "predicate", "left").join(s, "subject", "left").join(o, "object", "left").join(texts, "chunk_id", "left")
    found = F.contains(squeeze(F.col("text")), squeeze(F.col("evidence")))
    reason = (
        F.when(F.col("domains").isNull(), "unknown_predicate")
        .when(F.col("s_type").isNull(), "dangling_subject")
        .when(F.col("o_type").isNull(), "dangling_object")
        .when(~F.coalesce(found, F.lit(False)), "evidence_not_found")
        .when(~F.array_contains("domains", F.col("s_type")), "domain_mismatch")
        .when(~F.array_contains("ranges", F.col("o_type")), "range_mismatch")
    )
    return j.select("edge_id", "predicate", reason.alias("reason"))


def integrity(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Rule by rule the keys that break it: duplicate_entity, duplicate_edge, dangling, no_provenance,
    bad_confidence, self_loop."""
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    twice = entities.groupBy("entity_id").count().filter("count > 1")
    again = edges.groupBy("subject", "predicate", "object", "chunk_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1")
    known = entities.select(F.col("entity_id").alias("subject")).distinct()
    loose = edges.join(known, "subject", "left_anti")
    bad = edges.filter("confidence is null or isnan(confidence) or confidence < 0 or confidence > 1")
    parts = [
        row(twice, "duplicate_entity", "entity_id"), row(again, "duplicate_edge", "id"), row(loose, "dangling", "id"),
        row(edges.filter("chunk_id is null or trim(chunk_id) = ''"), "no_provenance", "id"), row(bad, "bad_confidence", "id"), row(edges.filter("subject = object"), "self_loop", "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def apply_merge(edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with merged nodes replaced, and what fell together: (edges, collisions).

    mapping: node, canonical. Edges that become loops are dropped; of those that become equal the one
    with the smallest id stays and the others are its further evidence (edge_id, kept_id).
    """
    s = mapping.select(F.col("node").alias("src"), F.col("canonical").alias("new_src"))
    d = mapping.select(F.col("node").alias("dst"), F.col("canonical").alias("new_dst"))
    moved = edges.join(s, "src", "left").join(d, "dst", "left").select("edge_id", F.coalesce("new_src", "src").alias("src"), "rel", F.coalesce("new_dst", "dst").alias("dst"))
    moved = moved.filter("src <> dst")
    kept = moved.groupBy("src", "rel", "dst").agg(F.min("edge_id").alias("edge_id"), F.count("*").alias("n"))
    collisions = moved.join(kept.filter("n > 1").select("src", "rel", "dst", F.col("edge_id").alias("kept_id")), ["src", "rel", "dst"]).filter("edge_id <> kept_id")
    return kept.select("edge_id", "src", "rel", "dst"), collisions.select("edge_id", "kept_id")


def numbered(df: DataFrame, within: list[str], by: list[str], name: str = "number") -> DataFrame:
    return df.withColumn(name, F.dense_rank().over(W.partitionBy(*within).orderBy(*by)))
