"""Queries of sinks and predicates, and of greedy operators against recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.functions.text import words
from quernlake.operators import graph as G
from quernlake.operators import ranking as rank
from quernlake.plans.graph import _E, _edges, _entities
from quernlake.plans.registry import Registry
from quernlake.session import table
from quernlake.sources import files

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""SELECT '{"index":{"_id":"' || id || '"}}' || chr(10) || '{"room_id":' || room_id || ',"seq":' || seq || '}' AS line FROM messages WHERE msg_type = 'text' AND room_id IS NOT NULL AND seq IS NOT NULL""")
def bulk_lines(spark: SparkSession, d: str) -> DataFrame:
    """An action and a document for each message, as a bulk request takes them."""
    m = table(spark, d, "messages").filter("msg_type = 'text' and room_id is not null and seq is not null")
    action = F.concat(F.lit('{"index":{"_id":"'), F.col("id").cast("string"), F.lit('"}}'))
    return m.select(F.concat(action, F.lit("\n"), F.to_json(F.struct("room_id", "seq"))).alias("line"))


@R.query("""SELECT batch, count(*) AS n, min(entity_id) AS first_id, 'UNWIND $rows AS row MERGE (n:Entity {id: row.id})' AS statement FROM (SELECT entity_id, (row_number() OVER (ORDER BY entity_id) - 1) // 500 AS batch FROM (SELECT DISTINCT entity_id FROM entities)) GROUP BY batch""")
def merge_batches(spark: SparkSession, d: str) -> DataFrame:
    """Nodes in batches of five hundred for a statement that merges them; numbers come from ranges."""
    n = rank.numbered(table(spark, d, "entities").select("entity_id").distinct(), [F.col("entity_id")], "n")
    g = n.groupBy(F.floor((F.col("n") - 1) / 500).alias("batch")).agg(F.count("*").alias("n"), F.min("entity_id").alias("first_id"))
    return g.withColumn("statement", F.lit("UNWIND $rows AS row MERGE (n:Entity {id: row.id})"))


@R.query("""SELECT '| ' || source || ' | ' || count(*) || ' | ' || count(text) || ' |' AS line FROM documents WHERE source IS NOT NULL GROUP BY source""")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a report's table in markdown."""
    g = table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("k"))
    return g.select(F.format_string("| %s | %d | %d |", "source", "n", "k").alias("line"))


@R.query("""SELECT '<' || subject_id || '> <' || predicate || '> ' || CASE WHEN object_literal IS NOT NULL THEN '"' || replace(replace(replace(object_literal, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"' ELSE '<' || object_id || '>' END || ' .' AS line FROM (SELECT DISTINCT id, subject_id, predicate, object_id, object_literal FROM kg_edges) WHERE coalesce(object_literal, object_id) IS NOT NULL""")
def turtle_literals(spark: SparkSession, d: str) -> DataFrame:
    """Triples with nodes and with escaped literals."""
    e = table(spark, d, "kg_edges").select("id", "subject_id", "predicate", "object_id", "object_literal").distinct()
    o = F.coalesce("object_literal", "object_id")
    return e.filter(o.isNotNull()).select(files.turtle(F.col("subject_id"), F.col("predicate"), o, F.col("object_literal").isNotNull()).alias("line"))


@R.query("SELECT doc_id FROM documents WHERE CAST(published_at AS DATE) BETWEEN DATE '2015-01-10' AND DATE '2015-01-20'")
def dates_inclusive(spark: SparkSession, d: str) -> DataFrame:
    """P5: both days belong to the range; no date belongs to none. Bounds are instants, so the scan sees them."""
    at = F.col("published_at")
    return table(spark, d, "documents").filter((at >= F.lit("2015-01-10").cast("timestamp")) & (at < F.lit("2015-01-21").cast("timestamp"))).select("doc_id")


@R.query("""SELECT id, len(list_filter(participants, lambda p: contains(p, ' '))) > 0 AS any_spaced, len(list_filter(participants, lambda p: length(p) < 3)) = 0 AS none_short, len(list_filter(participants, lambda p: length(p) >= 3)) = len(participants) AS all_long FROM chunks WHERE participants IS NOT NULL AND len(list_filter(participants, lambda p: p IS NULL)) = 0""")
def list_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Any, none and all of a list."""
    p = F.col("participants")
    c = table(spark, d, "chunks").filter(p.isNotNull() & ~F.exists(p, lambda x: x.isNull()))
    return c.select("id", F.exists(p, lambda x: x.contains(" ")).alias("any_spaced"), (~F.exists(p, lambda x: F.length(x) < 3)).alias("none_short"), F.forall(p, lambda x: F.length(x) >= 3).alias("all_long"))


@R.query("SELECT entity_id, min(label) AS label FROM entities WHERE entity_type IN ('project', 'organization') AND (starts_with(label, 'Project') OR starts_with(label, 'The ')) GROUP BY entity_id")
def typed_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of some types whose label starts so."""
    e = table(spark, d, "entities").filter(F.col("entity_type").isin("project", "organization") & (F.col("label").startswith("Project") | F.col("label").startswith("The ")))
    return e.groupBy("entity_id").agg(F.min("label").alias("label"))


@R.query("""SELECT id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS words FROM (SELECT id, regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+') AS w FROM chunks WHERE text IS NOT NULL)""")
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Each word once, where it stood first."""
    return table(spark, d, "chunks").filter("text is not null").select("id", F.array_join(F.array_distinct(words(F.col("text"))), " ").alias("words"))


@R.query("""SELECT event_type, count(*) AS n, round(1000.0 * sum(value) / count(*), 4) AS per_thousand, round(sum(value) / nullif(count(DISTINCT user_id), 0), 4) AS per_user, round(100.0 * count(*) / (SELECT count(*) FROM events), 4) AS share FROM events GROUP BY event_type""")
def cost_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Costs per thousand, per user and shares, as they are defined."""
    e = table(spark, d, "events")
    whole = F.lit(e.count())
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.count_distinct("user_id").alias("u"))
    return g.select("event_type", "n", F.round(1000.0 * F.col("v") / F.col("n"), 4).alias("per_thousand"), F.round(F.try_divide("v", F.col("u")), 4).alias("per_user"), F.round(100.0 * F.col("n") / whole, 4).alias("share"))


@R.query("""WITH r AS (SELECT extraction_run AS run, id, subject, confidence FROM (SELECT DISTINCT id, extraction_run, subject, confidence FROM edges) WHERE extraction_run IS NOT NULL), k AS (SELECT run, id, max(confidence) AS best FROM r GROUP BY run, id)
 SELECT r.run, count(*) AS n, count(*) FILTER (r.confidence IS NOT DISTINCT FROM k.best) AS n_best FROM r JOIN k ON k.run = r.run AND k.id = r.id GROUP BY r.run""")
def composite_join(spark: SparkSession, d: str) -> DataFrame:
    """A join on run and id together."""
    r = table(spark, d, "edges").select(F.col("extraction_run").alias("run"), "id", "subject", "confidence").distinct().filter("run is not null")
    k = r.groupBy("run", "id").agg(F.max("confidence").alias("best"))
    return r.join(k, ["run", "id"]).groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("confidence").eqNullSafe(F.col("best"))).alias("n_best"))


@R.query("""WITH a AS (SELECT DISTINCT entity_id, regexp_replace(lower(label), '[^0-9a-z가-힣]', '', 'g') AS key, lower(label) AS name FROM entities WHERE label IS NOT NULL), n AS (SELECT key, count(DISTINCT entity_id) AS n, count(DISTINCT name) AS spellings FROM a WHERE key <> '' GROUP BY key)
 SELECT key, n, CASE WHEN spellings = 1 THEN 'matched' ELSE 'related_not_merged' END AS state FROM n WHERE n > 1""")
def related_names(spark: SparkSession, d: str) -> DataFrame:
    """M3: nodes of one name are matched; those of names alike but for marks are related and not merged."""
    a = table(spark, d, "entities").filter("label is not null").select("entity_id", F.regexp_replace(F.lower("label"), "[^0-9a-z가-힣]", "").alias("key"), F.lower("label").alias("name")).filter("key <> ''")
    n = a.groupBy("key").agg(F.count_distinct("entity_id").alias("n"), F.count_distinct("name").alias("s")).filter("n > 1")
    return n.select("key", "n", F.when(F.col("s") == 1, "matched").otherwise("related_not_merged").alias("state"))


@R.query("""WITH c AS (SELECT DISTINCT edge_id, unnest([chunk_id]) AS cited FROM kg_evidence), k AS (SELECT DISTINCT id FROM document_chunks) SELECT edge_id, count(*) AS n_cited, count(*) FILTER (cited NOT IN (SELECT id FROM k)) AS n_unknown FROM c WHERE cited IS NOT NULL GROUP BY edge_id""")
def unknown_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of a statement, and those of ids that nobody has."""
    c = table(spark, d, "kg_evidence").select("edge_id", F.col("chunk_id").alias("id")).distinct().filter("id is not null")
    k = table(spark, d, "document_chunks").select("id", F.lit(1).alias("k")).distinct()
    return c.join(k, "id", "left").groupBy("edge_id").agg(F.count("*").alias("n_cited"), F.count_if(F.col("k").isNull()).alias("n_unknown"))


@R.query("""SELECT extraction_run AS run, round(avg(CASE WHEN confidence >= 0.7 THEN 1 WHEN confidence >= 0.4 THEN 0.5 ELSE 0 END), 6) AS score, round(count(*) FILTER (confidence < 0.4) / count(*), 6) AS wrong_rate FROM (SELECT DISTINCT id, extraction_run, confidence FROM edges WHERE confidence IS NOT NULL) GROUP BY extraction_run""")
def verdict_score(spark: SparkSession, d: str) -> DataFrame:
    """Right, half right and wrong as numbers, and the rate of a judge's flag. Bounds are floats, as
    the confidence is: a stored 0.7 is less than the double."""
    e = table(spark, d, "edges").filter("confidence is not null").select("id", "extraction_run", "confidence").distinct()
    right, half = F.lit(0.7).cast("float"), F.lit(0.4).cast("float")
    points = F.when(F.col("confidence") >= right, 1.0).when(F.col("confidence") >= half, 0.5).otherwise(0.0)
    g = e.groupBy(F.col("extraction_run").alias("run"))
    return g.agg(F.round(F.avg(points), 6).alias("score"), F.round(F.count_if(F.col("confidence") < half) / F.count("*"), 6).alias("wrong_rate"))


@R.query("""WITH w AS (SELECT doc_id, coalesce(nullif(regexp_extract(title, '(?i)week ?([0-9]{1,2})', 1), ''), nullif(regexp_extract(text, '(?i)week ?([0-9]{1,2})', 1), '')) AS said, title, published_at FROM documents)
 SELECT doc_id, coalesce(CAST(said AS BIGINT), CASE WHEN published_at >= TIMESTAMPTZ '2015-01-05 00:00:00+00' THEN date_diff('day', DATE '2015-01-05', CAST(published_at AS DATE)) // 7 + 1 END) AS week,
 CASE WHEN regexp_matches(title, '(?i)week ?[0-9]{1,2}') THEN 'title' WHEN said IS NOT NULL THEN 'text' WHEN published_at >= TIMESTAMPTZ '2015-01-05 00:00:00+00' THEN 'date' ELSE 'none' END AS told_by FROM w""")
def week_inference(spark: SparkSession, d: str) -> DataFrame:
    """The week by the title, the text or the date, and by which of them."""
    pick = lambda c: F.nullif(F.regexp_extract(c, "(?i)week ?([0-9]{1,2})", 1), F.lit(""))
    at = F.col("published_at")
    since = F.when(at >= F.lit("2015-01-05").cast("timestamp"), F.floor(F.datediff(at.cast("date"), F.lit("2015-01-05").cast("date")) / 7) + 1)
    told = F.when(pick("title").isNotNull(), "title").when(pick("text").isNotNull(), "text").when(since.isNotNull(), "date").otherwise("none")
    return table(spark, d, "documents").select("doc_id", F.coalesce(pick("title").cast("bigint"), pick("text").cast("bigint"), since).alias("week"), told.alias("told_by"))


@R.query("""SELECT id, page_id, title, source, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, coalesce(content, '') DESC) AS r FROM document_chunks WHERE loaded_at IS NOT NULL) WHERE r = 1""")
def latest_chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of each thread's rows the latest, by content where two came at once."""
    rows = table(spark, d, "document_chunks").filter("loaded_at is not null").select("id", "page_id", "title", "source", "loaded_at", F.coalesce("content", F.lit("")).alias("c"))
    best = rows.groupBy("id").agg(F.max_by(F.struct("page_id", "title", "source", "loaded_at"), F.struct("loaded_at", "c")).alias("b"))
    return best.select("id", "b.page_id", "b.title", "b.source", "b.loaded_at")


_ROUND = """, l{k} AS (SELECT node, community FROM (SELECT node, community, row_number() OVER (PARTITION BY node ORDER BY n DESC, community) AS r FROM (SELECT x.node, l.community, count(*) AS n FROM near x JOIN l{j} l ON l.node = x.other GROUP BY ALL)) WHERE r = 1)"""
_LPA = _E + ", l0 AS (SELECT DISTINCT node, node AS community FROM near)" + "".join(_ROUND.format(k=k, j=k - 1) for k in range(1, 6))


@R.query(_LPA + " SELECT community, count(*) AS size, count(*) FILTER (entity_type = 'person') AS persons, min(label) AS first_label FROM l5 LEFT JOIN ents ON entity_id = node GROUP BY community HAVING count(*) >= 4")
def community_rows(spark: SparkSession, d: str) -> DataFrame:
    """Communities of at least four with their sizes and types, after five rounds of votes."""
    members = G.label_propagation(_edges(spark, d)).join(_entities(spark, d).withColumnRenamed("entity_id", "node"), "node", "left")
    return members.groupBy("community").agg(F.count("*").alias("size"), F.count_if(F.col("entity_type") == "person").alias("persons"), F.min("label").alias("first_label")).filter("size >= 4")
