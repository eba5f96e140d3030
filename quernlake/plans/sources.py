"""Queries that read and write by the sources: what is written must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.plans.registry import Registry
from quernlake.session import scratch_dir, table
from quernlake.sources import files
from quernlake.streaming.sessions import stream_once, stream_sessions

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@R.query("SELECT id, room_id, seq, text FROM messages")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Messages through JSON lines."""
    path = _place(spark, "jsonl")
    files.write_jsonl(table(spark, d, "messages").select("id", "room_id", "seq", "text"), path, exclusive=True)
    return files.read_jsonl(spark, path, "id bigint, room_id int, seq int, text string", strict=True)


@R.query("SELECT source, count(*) AS n, count(content) AS n_content, CAST(sum(length(content)) AS BIGINT) AS chars FROM document_chunks GROUP BY source")
def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without their vectors through a compressed snapshot by type."""
    path = _place(spark, "snapshot")
    nodes = table(spark, d, "document_chunks").select("id", F.col("source").alias("type"), "content", "embedding")
    edges = table(spark, d, "edges").select("id", "subject", "object")
    files.write_snapshot(nodes, edges, path)
    back = spark.read.schema("id string, content string, type string").json(f"{path}/nodes")
    return back.groupBy(F.col("type").alias("source")).agg(F.count("*").alias("n"), F.count("content").alias("n_content"), F.sum(F.length("content")).alias("chars"))


@R.query("""SELECT s, count(*) AS n_predicates, CAST(sum(k) AS BIGINT) AS n_values FROM (SELECT subject_id AS s, predicate, count(DISTINCT coalesce(object_id, object_literal)) AS k FROM kg_edges WHERE coalesce(object_id, object_literal) IS NOT NULL GROUP BY ALL) GROUP BY s""")
def jsonld_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object per subject, read again."""
    t = table(spark, d, "kg_edges").select(F.col("subject_id").alias("s"), F.col("predicate").alias("p"), F.coalesce("object_id", "object_literal").alias("o")).filter("o is not null")
    read = F.from_json("node", "map<string,array<string>>")
    sizes = F.aggregate(F.map_values(read), F.lit(0).cast("bigint"), lambda a, x: a + F.size(x))
    return files.json_ld(t).select("s", F.size(read).cast("bigint").alias("n_predicates"), sizes.alias("n_values"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _run(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = _place(spark, name)
    query = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@R.query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def streaming_dedup(spark: SparkSession, d: str) -> DataFrame:
    """M1 as a stream: each event once."""
    events = _stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return _run(stream_once(events, ["event_id"], "at"), "dedup").select("event_id", "user_id", "event_type")


@R.query("""WITH s AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true) AS brk FROM events))
 SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    """C7 as a stream: sessions that the watermark has closed."""
    events = _stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return _run(stream_sessions(events, "user_id", "at"), "sessions").select("user_id", "n")
