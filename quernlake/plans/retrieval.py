"""Queries of graph retrieval, of context for answers and of comparing methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernlake.functions.text import preview, squeeze, words
from quernlake.operators import dense
from quernlake.operators import graph as G
from quernlake.operators import ranking as rank
from quernlake.plans.graph import _E, _edges, _entities
from quernlake.plans.registry import Registry
from quernlake.plans.search import _ARMS, _QSQL, QUESTIONS, _lists
from quernlake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: Fixed value: neighbours beyond which a node is a hub, listed but not expanded.
HUB = 20
_SEED = "rollback"
_CHUNKED = """WITH c AS (SELECT DISTINCT id AS edge_id, subject AS src, predicate AS rel, object AS dst, chunk_id, evidence, extraction_run AS run FROM edges WHERE object IS NOT NULL AND regexp_matches(object, '\\S')),
 hit AS (SELECT DISTINCT id FROM document_chunks WHERE contains(lower(content), 'rollback')),
 seed AS (SELECT DISTINCT edge_id, src, dst FROM c WHERE chunk_id IN (SELECT id FROM hit) AND rel = 'USES'),
 users AS (SELECT dst, count(DISTINCT src) AS n FROM c WHERE rel = 'USES' GROUP BY dst),
 grown AS (SELECT edge_id, src, dst, 1 AS hop FROM seed UNION ALL SELECT DISTINCT edge_id, src, dst, 2 FROM c JOIN users USING (dst) WHERE rel = 'USES' AND n <= 20 AND dst IN (SELECT dst FROM seed) AND edge_id NOT IN (SELECT edge_id FROM seed)) """


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").filter(F.col("object").rlike(r"\S"))
    return e.select(F.col("id").alias("edge_id"), F.col("subject").alias("src"), F.col("predicate").alias("rel"), F.col("object").alias("dst"), "chunk_id", "evidence", F.col("extraction_run").alias("run")).distinct()


def _grown(spark: SparkSession, d: str) -> DataFrame:
    hit = table(spark, d, "document_chunks").filter(F.lower("content").contains(_SEED)).select(F.col("id").alias("chunk_id")).distinct()
    uses = _chunked(spark, d).filter("rel = 'USES'")
    seed = uses.join(hit, "chunk_id", "left_semi").select("edge_id", "src", "dst").distinct()
    calm = uses.groupBy("dst").agg(F.count_distinct("src").alias("n")).filter(F.col("n") <= HUB).select("dst")
    more = uses.join(seed.select("dst").distinct().join(calm, "dst"), "dst", "left_semi").select("edge_id", "src", "dst").distinct().join(seed, "edge_id", "left_anti")
    return seed.withColumn("hop", F.lit(1)).unionByName(more.withColumn("hop", F.lit(2)))


@R.query(_CHUNKED + "SELECT edge_id, src, dst, hop FROM grown")
def seeded_expand_hub_cap(spark: SparkSession, d: str) -> DataFrame:
    """From chunks that were found to what they use, and from there to all that use it too; hubs
    are listed, not expanded."""
    return _grown(spark, d)


@R.query(_CHUNKED + ", nodes AS (SELECT src AS node FROM grown UNION SELECT dst FROM grown) SELECT rel, count(DISTINCT edge_id) AS n FROM c WHERE rel <> 'USES' AND src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes) GROUP BY rel")
def seeded_support(spark: SparkSession, d: str) -> DataFrame:
    """The other edges between what the expansion reached."""
    g = _grown(spark, d)
    nodes = g.select(F.col("src").alias("node")).unionByName(g.select(F.col("dst").alias("node"))).distinct()
    e = _chunked(spark, d).filter("rel <> 'USES'")
    inside = e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside.groupBy("rel").agg(F.count_distinct("edge_id").alias("n"))


@R.query(_CHUNKED + """SELECT src, dst, array_to_string(list_sort(list_distinct(list(run) FILTER (run IS NOT NULL))), ',') AS states, count(DISTINCT edge_id) AS n, count(DISTINCT chunk_id) AS n_chunks, max(length(evidence)) AS longest FROM c GROUP BY src, dst HAVING count(DISTINCT run) > 1""")
def status_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Pairs about which facts of several states are held, with their evidence."""
    g = _chunked(spark, d).groupBy("src", "dst")
    out = g.agg(F.array_sort(F.collect_set("run")).alias("s"), F.count_distinct("edge_id").alias("n"), F.count_distinct("chunk_id").alias("n_chunks"), F.max(F.length("evidence")).cast("bigint").alias("longest"))
    return out.filter(F.size("s") > 1).select("src", "dst", F.array_join("s", ",").alias("states"), "n", "n_chunks", "longest")


@R.query(_CHUNKED + """, one AS (SELECT src, run, rel || ' ' || dst AS fact FROM c WHERE run IS NOT NULL GROUP BY ALL), placed AS (SELECT *, sum(length(fact) + 2) OVER (PARTITION BY src, run ORDER BY fact ROWS UNBOUNDED PRECEDING) AS upto FROM one)
 SELECT src, run, string_agg(fact, '; ' ORDER BY fact) FILTER (upto <= 802) AS facts, count(*) AS n FROM placed GROUP BY src, run""")
def fact_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a node and state in order, whole ones up to 800 characters."""
    one = _chunked(spark, d).filter("run is not null").select("src", "run", F.concat_ws(" ", "rel", "dst").alias("fact")).distinct()
    upto = F.sum(F.length("fact") + 2).over(W.partitionBy("src", "run").orderBy("fact").rowsBetween(W.unboundedPreceding, 0))
    kept = F.array_sort(F.collect_list(F.when(F.col("upto") <= 802, F.col("fact"))))
    out = one.withColumn("upto", upto).groupBy("src", "run").agg(kept.alias("k"), F.count("*").alias("n"))
    return out.select("src", "run", F.when(F.size("k") > 0, F.array_join("k", "; ")).alias("facts"), "n")


def _first_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, t, t.split()[0]) for q, t in QUESTIONS], "query_id string, question string, word string")


def _matched(spark: SparkSession, rows: DataFrame, text: str) -> DataFrame:
    """Rows that hold a question's first word, once a question: one scan, the questions are a bounded list."""
    found = F.filter(F.array(*(F.struct(F.lit(q).alias("query_id"), F.lit(t.split()[0]).alias("word")) for q, t in QUESTIONS)), lambda x: F.contains(F.lower(text), x["word"]))
    return rows.select("*", F.explode(found).alias("_q")).select("*", "_q.query_id").drop("_q")


@R.query(f"""WITH h AS (SELECT DISTINCT query_id, id, evidence, confidence FROM edges JOIN (VALUES {_QSQL}) v(query_id, t) ON contains(lower(evidence), split_part(t, ' ', 1)))
 SELECT query_id, place, id AS edge_id, '[' || place || '] ' || evidence AS block FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC NULLS LAST, id) AS place FROM h) WHERE place <= 10""")
def local_search(spark: SparkSession, d: str) -> DataFrame:
    """Statements near what a question names, the surest ten as numbered blocks."""
    e = table(spark, d, "edges").select("id", "evidence", "confidence").distinct()
    top = rank.top_k(_matched(spark, e, "evidence"), ["query_id"], [F.desc_nulls_last("confidence"), F.col("id")], 10, "id", rank="place")
    return top.select("query_id", "place", F.col("id").alias("edge_id"), F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("evidence")).alias("block"))


@R.query(f"""WITH q AS (SELECT * FROM (VALUES {_QSQL}, ('q5', 'nothing has this')) v(query_id, t)), own AS (SELECT query_id, 'aggregate' AS route, predicate AS key, count(DISTINCT id) AS n FROM q JOIN edges ON contains(lower(evidence), split_part(t, ' ', 1)) GROUP BY ALL)
 SELECT * FROM own UNION ALL SELECT query_id, 'local', NULL, 0 FROM q WHERE query_id NOT IN (SELECT query_id FROM own)""")
def aggregate_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Counts by relation; a question without any goes on to the local search."""
    own = _matched(spark, table(spark, d, "edges").select("id", "predicate", "evidence"), "evidence")
    own = own.groupBy("query_id", F.lit("aggregate").alias("route"), F.col("predicate").alias("key")).agg(F.count_distinct("id").alias("n"))
    asked = spark.createDataFrame([(q,) for q, _ in QUESTIONS] + [("q5",)], "query_id string")
    none = asked.join(own, "query_id", "left_anti").select("query_id", F.lit("local").alias("route"), F.lit(None).cast("string").alias("key"), F.lit(0).cast("bigint").alias("n"))
    return own.unionByName(none)


@R.query(f"""WITH s AS (SELECT query_id, source || '/' || lang AS community, count(*) AS size, round(100.0 * count(*) FILTER (contains(lower(text), split_part(t, ' ', 1))) / count(*), 6) AS score FROM documents, (VALUES {_QSQL}) v(query_id, t) WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL)
 SELECT query_id, community, size, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS place FROM s WHERE score >= 1) WHERE place <= 20""")
def global_search(spark: SparkSession, d: str) -> DataFrame:
    """Each community scored against each question in one pass, the twenty best of those above a bar.
    The score is the share of members that name it, where a language model would be asked."""
    docs = table(spark, d, "documents").filter("source is not null and lang is not null and text is not null")
    hits = [F.count_if(F.contains(F.lower("text"), F.lit(t.split()[0]))).alias(q) for q, t in QUESTIONS]
    by = docs.groupBy(F.concat_ws("/", "source", "lang").alias("community")).agg(F.count("*").alias("size"), *hits)
    each = by.select("community", "size", F.explode(F.array(*(F.struct(F.lit(q).alias("query_id"), F.round(100.0 * F.col(q) / F.col("size"), 6).alias("score")) for q, _ in QUESTIONS))).alias("s"))
    scored = each.select("s.query_id", "community", "size", "s.score").filter("score >= 1")
    return rank.top_k(scored, ["query_id"], [F.desc("score"), F.col("community")], 20, "community", rank="place").select("query_id", "community", "size", "score", "place")


@R.query(_CHUNKED + "SELECT dst AS technology, count(DISTINCT src) AS n_projects, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT edge_id) AS n_uses FROM c WHERE rel = 'USES' GROUP BY dst")
def experience_by_technology(spark: SparkSession, d: str) -> DataFrame:
    """Who has used what, and how much is known of it."""
    g = _chunked(spark, d).filter("rel = 'USES'").groupBy(F.col("dst").alias("technology"))
    return g.agg(F.count_distinct("src").alias("n_projects"), F.count_distinct("chunk_id").alias("n_chunks"), F.count_distinct("edge_id").alias("n_uses"))


@R.query(_CHUNKED + """, p AS (SELECT src, dst, bool_and(coalesce(run = 'run-01', false)) AS proposed FROM c WHERE rel = 'USES' GROUP BY src, dst)
 SELECT src, dst, dst IN (SELECT dst FROM p WHERE NOT proposed) AS elsewhere FROM p WHERE proposed""")
def proposed_only(spark: SparkSession, d: str) -> DataFrame:
    """Uses that only the first run knows, and whether another node has them for good."""
    p = _chunked(spark, d).filter("rel = 'USES'").groupBy("src", "dst").agg(F.bool_and(F.coalesce(F.col("run") == "run-01", F.lit(False))).alias("proposed"))
    there = p.filter("not proposed").select("dst", F.lit(True).alias("t")).distinct()
    return p.filter("proposed").join(there, "dst", "left").select("src", "dst", F.coalesce("t", F.lit(False)).alias("elsewhere"))


@R.query("""WITH e AS (SELECT DISTINCT id, subject, chunk_id FROM edges), s AS (SELECT id, min(source) AS source FROM document_chunks GROUP BY id)
 SELECT subject, count(DISTINCT e.id) AS n, count(DISTINCT e.id) FILTER (s.source IS DISTINCT FROM 'notion') AS n_secondary FROM e LEFT JOIN s ON s.id = chunk_id GROUP BY subject""")
def secondary_only(spark: SparkSession, d: str) -> DataFrame:
    """Statements of a node, and those not from the primary source; no source is not it."""
    e = table(spark, d, "edges").select("id", "subject", "chunk_id").distinct()
    s = table(spark, d, "document_chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.min("source").alias("source"))
    other = ~F.col("source").eqNullSafe(F.lit("notion"))
    return e.join(s, "chunk_id", "left").groupBy("subject").agg(F.count_distinct("id").alias("n"), F.count_distinct(F.when(other, F.col("id"))).alias("n_secondary"))


@R.query("""WITH s AS (SELECT DISTINCT id FROM document_chunks WHERE source = 'notion') SELECT DISTINCT id, subject, predicate, object FROM edges WHERE chunk_id IN (SELECT id FROM s)""")
def primary_view(spark: SparkSession, d: str) -> DataFrame:
    """The graph that the primary source alone supports."""
    s = table(spark, d, "document_chunks").filter("source = 'notion'").select(F.col("id").alias("chunk_id")).distinct()
    return table(spark, d, "edges").join(s, "chunk_id", "left_semi").select("id", "subject", "predicate", "object").distinct()


_LINK = _E + """, u AS (SELECT DISTINCT src, dst FROM e WHERE rel = 'USES'), l AS (SELECT a.src AS x, b.src AS y, count(*) AS n, min(a.dst) AS via FROM u a JOIN u b ON a.dst = b.dst AND a.src <> b.src GROUP BY ALL),
 starts AS (SELECT entity_id AS node FROM ents WHERE CAST(regexp_replace(entity_id, '\\D', '', 'g') AS BIGINT) % 50 = 0)"""


@R.query(_LINK + """SELECT x AS start, y AS "end", 1 AS hops, n AS n_paths, via AS chain FROM l WHERE x IN (SELECT node FROM starts) UNION ALL
 SELECT a.x, b.y, 2, CAST(sum(a.n * b.n) AS BIGINT), min(a.via || '/' || b.via) FROM l a JOIN l b ON a.y = b.x WHERE a.x IN (SELECT node FROM starts) AND b.y <> a.x GROUP BY a.x, b.y""")
def project_paths(spark: SparkSession, d: str) -> DataFrame:
    """Nodes linked by what they both use, over one and two links, from every node whose number is
    divisible by 50. Links grow from the starts; nobody else's are made."""
    u = _edges(spark, d).filter("rel = 'USES'").select("src", "dst").distinct()
    # The last digits tell what 50 divides: no cast, as the optimizer carries this filter over to the ends of
    # edges, which may hold no digit.
    starts = _entities(spark, d).select(F.col("entity_id").alias("src")).filter(F.regexp_replace("src", r"\D", "").rlike("^0$|[05]0$"))

    def links(of: DataFrame) -> DataFrame:
        mine = u.join(of, "src", "left_semi").select(F.col("src").alias("x"), "dst")
        return G.meet(u, mine, "dst", "src").filter("src <> x").groupBy("x", F.col("src").alias("y")).agg(F.count("*").alias("n"), F.min("dst").alias("via"))

    one = links(starts)
    two = links(one.select(F.col("y").alias("src")).distinct()).select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("n").alias("m"), F.col("via").alias("then"))
    far = G.meet(one, two, "y", "x").filter("z <> x").groupBy("x", "z").agg(F.sum(F.col("n") * F.col("m")).alias("n"), F.min(F.concat_ws("/", "via", "then")).alias("chain"))
    near = one.select(F.col("x").alias("start"), F.col("y").alias("end"), F.lit(1).alias("hops"), F.col("n").alias("n_paths"), F.col("via").alias("chain"))
    return near.unionByName(far.select(F.col("x").alias("start"), F.col("z").alias("end"), F.lit(2).alias("hops"), F.col("n").alias("n_paths"), "chain"))


@R.query(_E + """, shown AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src, rel ORDER BY dst, edge_id) AS place FROM e) WHERE place <= 3), nodes AS (SELECT src AS node FROM shown UNION SELECT dst FROM shown)
 SELECT entity_type, count(*) AS n, count(*) FILTER (entity_id NOT IN (SELECT node FROM nodes)) AS n_missing FROM ents GROUP BY entity_type""")
def overview_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What an overview of three edges a node and relation doesn't show."""
    shown = rank.top_k(_edges(spark, d), ["src", "rel"], [F.col("dst"), F.col("edge_id")], 3, "edge_id")
    nodes = shown.select(F.col("src").alias("entity_id")).unionByName(shown.select(F.col("dst").alias("entity_id"))).distinct().withColumn("s", F.lit(1))
    return _entities(spark, d).join(nodes, "entity_id", "left").groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(F.col("s").isNull()).alias("n_missing"))


@R.query("""WITH k AS (SELECT DISTINCT id, chunk_id, heading, evidence FROM kg_evidence), c AS (SELECT id, min(page_id) AS page_id, min(source) AS source FROM document_chunks GROUP BY id)
 SELECT k.id, c.page_id, coalesce(nullif(trim(k.heading, ' '), ''), '(none)') AS heading, CASE WHEN c.source IN ('repo', 'notion') THEN 'primary' WHEN c.source IS NULL THEN 'lost' ELSE 'secondary' END AS tier FROM k LEFT JOIN c ON c.id = k.chunk_id""")
def evidence_context(spark: SparkSession, d: str) -> DataFrame:
    """Z3: evidence with its page, heading and the tier of its source."""
    k = table(spark, d, "kg_evidence").select("id", "chunk_id", "heading", "evidence").distinct()
    c = table(spark, d, "document_chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.min("page_id").alias("page_id"), F.min("source").alias("source"))
    tier = F.when(F.col("source").isin("repo", "notion"), "primary").when(F.col("source").isNull(), "lost").otherwise("secondary")
    return k.join(c, "chunk_id", "left").select("id", "page_id", F.coalesce(F.nullif(F.trim("heading"), F.lit("")), F.lit("(none)")).alias("heading"), tier.alias("tier"))


@R.query(_ARMS + """SELECT query_id, string_agg('[' || rank || '] ' || coalesce(title, '-'), chr(10) ORDER BY rank) AS context, count(*) AS n FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 8 GROUP BY query_id""")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Numbered blocks of the documents found, one text a question."""
    top = _lists(spark, d).filter("method = 'bm25' and rank <= 8").join(table(spark, d, "documents").select("doc_id", "title"), "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("-")))
    g = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"), F.count("*").alias("n"))
    return g.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"), "n")


@R.query("""SELECT id FROM (SELECT min(id) AS id FROM document_chunks WHERE contains(lower(content), 'rollback') GROUP BY sha256(trim(regexp_replace(lower(content), '[\\s\\x{00A0}]+', ' ', 'g'), ' '))) ORDER BY id LIMIT 50""")
def keyword_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty chunks that hold a word, each content once."""
    hit = table(spark, d, "document_chunks").filter(F.lower("content").contains(_SEED))
    return hit.groupBy(F.sha2(squeeze(F.lower("content")), 256).alias("h")).agg(F.min("id").alias("id")).select("id").orderBy("id").limit(50)


@R.query("""SELECT room_id || '-' || seq AS message_key, min(id) AS id, count(*) AS n FROM messages WHERE msg_type IN ('text', 'link') AND text IS NOT NULL GROUP BY room_id, seq""")
def message_feed(spark: SparkSession, d: str) -> DataFrame:
    """Messages for an index, texts and links only, each position once."""
    m = table(spark, d, "messages").filter("msg_type in ('text', 'link') and text is not null")
    return m.groupBy(F.concat_ws("-", F.col("room_id").cast("string"), F.col("seq").cast("string")).alias("message_key")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@R.query(_ARMS + "SELECT query_id, method, count(*) AS n_hits, round(max(score), 6) AS top_score, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 5) AS ids FROM lists GROUP BY ALL")
def batch_runner(spark: SparkSession, d: str) -> DataFrame:
    """Each question by each method: hits, best score and first ids."""
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", F.col("doc_id").cast("string").alias("i")))))
    g = _lists(spark, d).groupBy("query_id", "method").agg(F.count("*").alias("n_hits"), F.round(F.max("score"), 6).alias("top_score"), first.alias("l"))
    return g.select("query_id", "method", "n_hits", "top_score", F.array_join(F.transform("l", lambda x: x["i"]), ",").alias("ids"))


# Gold of a question: documents that hold its first two words.
_GOLD = _ARMS + f""", gold AS (SELECT query_id, doc_id FROM documents JOIN (VALUES {_QSQL}) v(query_id, t) ON contains(lower(text), split_part(t, ' ', 1)) AND contains(lower(text), split_part(t, ' ', 2)) WHERE text IS NOT NULL), n_gold AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id)"""


def _gold(spark: SparkSession, d: str) -> DataFrame:
    def both(t: str) -> Column:
        parts = [*t.split(), ""][:2]
        return F.contains(F.lower("text"), F.lit(parts[0])) & F.contains(F.lower("text"), F.lit(parts[1]))

    ids = F.filter(F.array(*(F.when(both(t), F.lit(q)) for q, t in QUESTIONS)), lambda x: x.isNotNull())
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(ids).alias("query_id"))


@R.query(_GOLD + """SELECT method, k, round(avg(hits / n), 6) AS recall, count(*) AS n_queries FROM (SELECT lists.method, k, n_gold.query_id, n, count(g.doc_id) AS hits FROM (SELECT DISTINCT method FROM lists), (VALUES (1), (3), (5), (10)) ks(k), n_gold
 LEFT JOIN lists l ON l.query_id = n_gold.query_id AND l.method = lists.method AND l.rank <= k LEFT JOIN gold g ON g.query_id = l.query_id AND g.doc_id = l.doc_id GROUP BY ALL) GROUP BY method, k""".replace("(SELECT DISTINCT method FROM lists)", "(SELECT DISTINCT method FROM lists) lists"))
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each method at several depths over the same questions."""
    gold = _gold(spark, d)
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    lists = _lists(spark, d)
    hits = lists.join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id", "method").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (1, 3, 5, 10)))
    every = sizes.select("*", F.explode(F.array(F.lit("bm25"), F.lit("grep"))).alias("method"))
    each = every.join(hits, ["query_id", "method"], "left").select("method", "n_gold", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("h")) for k in (1, 3, 5, 10)))).alias("x"))
    return each.groupBy("method", F.col("x.k").alias("k")).agg(F.round(F.avg(F.col("x.h") / F.col("n_gold")), 6).alias("recall"), F.count("*").alias("n_queries"))


@R.query(_ARMS + """, shared AS (SELECT l.query_id, l.method, l.doc_id, row_number() OVER (PARTITION BY l.query_id, l.method ORDER BY l.rank) AS rank FROM lists l JOIN documents d ON d.doc_id = l.doc_id AND d.source = 'notion')
 SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM shared GROUP BY ALL)""")
def restricted_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Both rankings cut to a shared corpus and ranked anew before they are fused."""
    shared = table(spark, d, "documents").filter("source = 'notion'").select("doc_id")
    kept = _lists(spark, d).join(shared, "doc_id", "left_semi")
    again = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "method").orderBy("rank")))
    return rank.reciprocal_rank_fusion(again).select("query_id", "doc_id", "score", "rank")


@R.query(_GOLD + """SELECT query_id, n AS n_gold, count(*) FILTER (l.doc_id IS NULL) AS n_missing, string_agg(CAST(g.doc_id AS VARCHAR), ',' ORDER BY g.doc_id) FILTER (l.doc_id IS NULL) AS missing FROM gold g JOIN n_gold USING (query_id) LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM lists WHERE rank <= 10) l USING (query_id, doc_id) GROUP BY query_id, n""")
def missing_gold(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents that an ideal context would hold those that no method gives."""
    seen = _lists(spark, d).filter("rank <= 10").select("query_id", "doc_id", F.lit(1).alias("s")).distinct()
    g = _gold(spark, d).join(seen, ["query_id", "doc_id"], "left").groupBy("query_id")
    out = g.agg(F.count("*").alias("n_gold"), F.count_if(F.col("s").isNull()).alias("n_missing"), F.array_sort(F.collect_list(F.when(F.col("s").isNull(), F.col("doc_id")))).alias("m"))
    return out.select("query_id", "n_gold", "n_missing", F.when(F.size("m") > 0, F.array_join(F.transform("m", lambda x: x.cast("string")), ",")).alias("missing"))


@R.query("""WITH c AS (SELECT DISTINCT id, subject, evidence, coalesce(confidence, 0) >= 0.5 AS ok FROM edges) SELECT subject, count(*) FILTER (ok) AS n_kept, count(*) FILTER (NOT ok) AS n_unresolved,
 CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'answered' WHEN count(*) FILTER (ok) = 0 THEN 'unanswered' ELSE 'partial' END AS status FROM c GROUP BY subject""")
def reviewer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Claims that hold stay, the others become open questions, and the answer gets its state."""
    c = table(spark, d, "edges").select("id", "subject", "evidence", (F.coalesce("confidence", F.lit(0.0)) >= 0.5).alias("ok")).distinct()
    g = c.groupBy("subject").agg(F.count_if("ok").alias("n_kept"), F.count_if(~F.col("ok")).alias("n_unresolved"))
    return g.withColumn("status", F.when(F.col("n_unresolved") == 0, "answered").when(F.col("n_kept") == 0, "unanswered").otherwise("partial"))


@R.query("""WITH q AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT query_id, d.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM q JOIN embeddings d ON d.label = q.label AND d.vec_id % 7 = q.query_id % 7)
 SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c""")
def rerank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """V8: given candidates, all of them, ranked anew by likeness to the query."""
    data = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding", (F.col("vec_id") % 7).alias("part"))
    q = data.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "label", F.col("embedding").alias("q"), "part")
    score = F.round(dense.dot(dense.unit(F.col("q")), dense.unit(F.col("embedding"))), 6)
    scored = data.join(q, ["label", "part"]).select("query_id", "id", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))


@R.query("""SELECT vec_id, CASE WHEN n = 0 OR m = 0 THEN NULL ELSE round(greatest(-1, least(1, dot / (sqrt(n) * sqrt(m)))), 6) END AS cosine FROM (SELECT a.vec_id, list_sum([CAST(x AS DOUBLE) * x FOR x IN a.embedding]) AS n, list_sum([CAST(x AS DOUBLE) * x FOR x IN b.embedding]) AS m, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dot FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b)""")
def cosine_clamped(spark: SparkSession, d: str) -> DataFrame:
    """V2: cosine to one vector within -1 and 1, null where a vector has no length."""
    data = table(spark, d, "embeddings")
    one = data.filter("vec_id = 0").select("embedding").first()
    q = F.array(*(F.lit(float(x)) for x in (one.embedding if one else [])))
    a, b = dense.norm(F.col("embedding")), dense.norm(q)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dense.dot(F.col("embedding"), q) / (a * b)))
    return data.select("vec_id", F.when((a > 0) & (b > 0), F.round(cosine, 6)).alias("cosine"))


@R.query("""SELECT doc_id FROM documents WHERE contains(lower(title), 'week') OR contains(lower(text), 'rollback plan')""")
def title_or_body(spark: SparkSession, d: str) -> DataFrame:
    """Fixed strings in the title or the body."""
    return table(spark, d, "documents").filter(F.contains(F.lower("title"), F.lit("week")) | F.contains(F.lower("text"), F.lit("rollback plan"))).select("doc_id")


@R.query("""SELECT doc_id FROM documents, (SELECT max(published_at) AS now FROM documents) WHERE published_at >= now - INTERVAL 7 DAY AND published_at <= now - INTERVAL 24 HOUR""")
def recent_window(spark: SparkSession, d: str) -> DataFrame:
    """Of the last seven days, but a day old at least; bounds are included."""
    docs = table(spark, d, "documents").select("doc_id", "published_at")
    now = F.lit(docs.agg(F.unix_micros(F.max("published_at"))).first()[0])
    at = F.unix_micros("published_at")
    return docs.filter((at >= now - 7 * 86_400_000_000) & (at <= now - 86_400_000_000)).select("doc_id")


@R.query("SELECT doc_id, source FROM documents WHERE source IN ('wiki', 'vault', 'repo') AND doc_id IN (SELECT doc_id FROM subject_labels)")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """A scope by a list, and one by a table."""
    scope = table(spark, d, "subject_labels").select("doc_id").distinct()
    return table(spark, d, "documents").filter(F.col("source").isin("wiki", "vault", "repo")).join(scope, "doc_id", "left_semi").select("doc_id", "source")


@R.query(f"""SELECT query_id, least(n, 201) AS n_fetched, CASE WHEN n > 200 THEN 'too many' ELSE 'ok' END AS verdict FROM (SELECT query_id, count(doc_id) AS n FROM (VALUES {_QSQL}) v(query_id, t) LEFT JOIN documents ON contains(lower(text), split_part(t, ' ', 1)) GROUP BY query_id)""")
def row_cap(spark: SparkSession, d: str) -> DataFrame:
    """O3: more rows than a cap are an error, so one more than the cap is enough to know."""
    hits = _matched(spark, table(spark, d, "documents").select("doc_id", "text"), "text")
    some = rank.top_k(hits, ["query_id"], [F.col("doc_id")], 201, "doc_id").groupBy("query_id").agg(F.count("*").alias("n_fetched"))
    asked = _first_words(spark).select("query_id").join(some, "query_id", "left").select("query_id", F.coalesce("n_fetched", F.lit(0)).cast("bigint").alias("n_fetched"))
    return asked.withColumn("verdict", F.when(F.col("n_fetched") > 200, "too many").otherwise("ok"))


@R.query("""SELECT doc_id, CAST(len(regexp_extract_all(lower(title), '[0-9A-Za-z가-힣]+')) AS BIGINT) AS n_words, CAST(len(string_split(title, ' ')) AS BIGINT) AS n_split, CAST(greatest(length(regexp_replace(lower(title), '[^0-9a-z가-힣]', '', 'g')) - 1, 0) AS BIGINT) AS n_pairs FROM documents WHERE title IS NOT NULL""")
def token_analysis(spark: SparkSession, d: str) -> DataFrame:
    """L4: what tokenizers make of the same text, side by side."""
    bare = F.length(F.regexp_replace(F.lower("title"), "[^0-9a-z가-힣]", ""))
    return table(spark, d, "documents").filter("title is not null").select(
        "doc_id", F.size(words(F.col("title"))).cast("bigint").alias("n_words"), F.size(F.split("title", " ")).cast("bigint").alias("n_split"), F.greatest(bare - 1, F.lit(0)).cast("bigint").alias("n_pairs")
    )


@R.query("SELECT doc_id FROM documents WHERE contains(lower(text), 'rollback plan')")
def trigram_search(spark: SparkSession, d: str) -> DataFrame:
    """Substring search by trigrams: documents that hold all of the pattern's are candidates, and
    only those are read for the pattern itself."""
    pattern = "rollback plan"
    wanted = sorted({pattern[k : k + 3] for k in range(len(pattern) - 2)})
    text = F.lower("text")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda k: F.substring(text, k, F.lit(3))))
    docs = table(spark, d, "documents").filter(F.length("text") >= len(pattern)).select("doc_id", "text", F.explode(grams).alias("gram"))
    hits = docs.filter(F.col("gram").isin(wanted)).groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text").alias("text")).filter(F.col("n") == len(wanted))
    return hits.filter(F.lower("text").contains(pattern)).select("doc_id")


@R.query("""SELECT doc_id, i AS window_no, least(n - i * 48, 64) AS n_tokens FROM (SELECT doc_id, n, unnest(range(0, greatest(1, CAST(ceil((n - 64) / 48.0) AS BIGINT) + 1))) AS i FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+')) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0)""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """C11: windows of 64 tokens every 48, the last as long as the text."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(words(F.col("text"))).cast("bigint").alias("n")).filter("n > 0")
    last = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("n") - 64) / 48.0))
    return docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("window_no")).select("doc_id", "window_no", F.least(F.col("n") - F.col("window_no") * 48, F.lit(64).cast("bigint")).alias("n_tokens"))


@R.query("""WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum([CAST(y AS DOUBLE) * y FOR y IN embedding]))) AS u FROM embeddings),
 p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM v) GROUP BY ALL) SELECT label, CAST(i - 1 AS BIGINT) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM p""")
def mean_pooled(spark: SparkSession, d: str) -> DataFrame:
    """C11: the mean of unit vectors, of length one again."""
    each = table(spark, d, "embeddings").select("label", F.posexplode(dense.unit(F.col("embedding"))).alias("i", "x"))
    mean = each.groupBy("label", "i").agg(F.avg("x").alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("label")))
    return mean.select("label", F.col("i").cast("bigint").alias("i"), F.round(F.col("x") / length, 6).alias("x"))


@R.query("""WITH n AS (SELECT member_id, source, count(*) AS n FROM documents GROUP BY ALL) SELECT member_id, CAST(sum(n) AS BIGINT) AS n_documents, count(source) AS n_sources, arg_max(source, (n, source)) FILTER (source IS NOT NULL) AS top_source FROM n GROUP BY member_id""")
def own_counts(spark: SparkSession, d: str) -> DataFrame:
    """A member's documents, sources and most used source, counted over all."""
    n = table(spark, d, "documents").groupBy("member_id", "source").agg(F.count("*").alias("n"))
    top = F.max_by("source", F.when(F.col("source").isNotNull(), F.struct("n", "source")))
    return n.groupBy("member_id").agg(F.sum("n").alias("n_documents"), F.count("source").alias("n_sources"), top.alias("top_source"))


@R.query("""SELECT doc_id, CASE WHEN length(x) > 40 THEN left(x, 40) || '…' ELSE x END AS line, CASE WHEN n = 0 THEN 'nothing found' WHEN n = 1 THEN '1 sentence' ELSE n || ' sentences' END AS summary FROM
 (SELECT doc_id, coalesce(nullif(trim(regexp_replace(title, '[\\s\\x{00A0}]+', ' ', 'g'), ' '), ''), '(untitled)') AS x, len(regexp_extract_all(coalesce(text, ''), '[.!?]')) AS n FROM documents)""")
def fallback_text(spark: SparkSession, d: str) -> DataFrame:
    """Titles and summaries by rule, where nothing better is at hand."""
    title = F.coalesce(F.nullif(squeeze(F.col("title")), F.lit("")), F.lit("(untitled)"))
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[.!?]"), F.lit(0)))
    summary = F.when(n == 0, "nothing found").when(n == 1, "1 sentence").otherwise(F.concat(n.cast("string"), F.lit(" sentences")))
    return table(spark, d, "documents").select("doc_id", preview(title, 40).alias("line"), summary.alias("summary"))
