"""Queries p2: the orphan references of the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.operators.references import orphan_references, orphan_report
from quernlake.session import table

#: (table, field, target table, key of the target)
FIELDS = (
    ("edges", "subject", "entities", "entity_id"),
    ("edges", "object", "entities", "entity_id"),
    ("kg_edges", "object_id", "kg_entities", "id"),
    ("kg_evidence", "chunk_id", "document_chunks", "id"),
)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = parents = None
    for name in dict.fromkeys(f[0] for f in FIELDS):
        fields = [f for f in FIELDS if f[0] == name]
        each = F.explode(
            F.array(*(F.struct(F.lit(f).alias("field_name"), F.lit(t).alias("target"), F.col(f).alias("ref_key")) for _, f, t, _ in fields))
        )
        df = table(spark, sf_dir, name).select(
            F.lit(name).alias("table_name"), F.col("id").cast("string").alias("row_id"), F.col("created_at").alias("at"), each.alias("r")
        ).select("table_name", "r.field_name", "row_id", "r.target", "r.ref_key", "at")
        refs = df if refs is None else refs.unionByName(df)
    for target, key in dict.fromkeys((f[2], f[3]) for f in FIELDS):
        df = table(spark, sf_dir, target).select(F.lit(target).alias("target"), F.col(key).alias("key"), "loaded_at", "deleted_at")
        parents = df if parents is None else parents.unionByName(df)
    return orphan_references(refs, parents)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "field_name", "row_id").distinct()


def p2_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_orphans_by_month": p2_orphans_by_month}


def _reason_sql(name: str, field: str, target: str, key: str) -> str:
    return f"""
SELECT '{name}' AS table_name, '{field}' AS field_name, CAST(r.id AS VARCHAR) AS row_id, r.created_at AS at_time,
  CASE WHEN NOT bool_or(p.{key} IS NOT NULL) THEN 'missing'
       WHEN r.created_at IS NULL THEN NULL
       WHEN coalesce(bool_or(p.loaded_at <= r.created_at AND (p.deleted_at IS NULL OR p.deleted_at > r.created_at)), false) THEN NULL
       WHEN coalesce(bool_or(p.loaded_at <= r.created_at), false) THEN 'removed'
       ELSE 'not_loaded' END AS reason
FROM (SELECT DISTINCT id, {field}, created_at FROM {name} WHERE regexp_matches({field}, '[^\\s\\p{{Z}}]')) r
LEFT JOIN {target} p ON p.{key} = r.{field}
GROUP BY r.id, r.{field}, r.created_at"""


_ALL = " UNION ALL ".join(_reason_sql(*f) for f in FIELDS)
SQL = {
    "p2_found": f"SELECT DISTINCT table_name, field_name, row_id FROM ({_ALL}) WHERE reason IS NOT NULL",
    "p2_orphans_by_month": f"""
SELECT table_name, field_name, strftime(at_time, '%Y-%m') AS month, reason, count(*) AS n_orphans
FROM (SELECT table_name, field_name, row_id, min({{'a': at_time, 'r': reason}}).a AS at_time, min({{'a': at_time, 'r': reason}}).r AS reason
      FROM ({_ALL}) WHERE reason IS NOT NULL GROUP BY ALL)
GROUP BY ALL""",
}
