"""Queries over the graph tables: patterns, paths, expansion, validation and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.operators import graph as G
from quernlake.operators import knowledge as K
from quernlake.operators import ranking as rank
from quernlake.plans.registry import Registry
from quernlake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

# Delivered once, with an object.
_E = """WITH e AS (SELECT id AS edge_id, subject AS src, predicate AS rel, object AS dst FROM (SELECT DISTINCT id, subject, predicate, object FROM edges) WHERE object IS NOT NULL AND regexp_matches(object, '\\S')),
 near AS (SELECT DISTINCT * FROM (SELECT src AS node, dst AS other FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst)),
 ents AS (SELECT entity_id, min(entity_type) AS entity_type, min(label) AS label FROM entities GROUP BY entity_id) """


def _edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select("id", "subject", "predicate", "object").distinct().filter(F.col("object").rlike(r"\S"))
    return e.select(F.col("id").alias("edge_id"), F.col("subject").alias("src"), F.col("predicate").alias("rel"), F.col("object").alias("dst"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").groupBy("entity_id").agg(F.min("entity_type").alias("entity_type"), F.min("label").alias("label"))


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).filter("entity_type = 'project'").select(F.col("entity_id").alias("node"))


@R.query(_E + "SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, coalesce(any_value(n), 0) AS n_neighbours FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) LEFT JOIN (SELECT node, count(*) AS n FROM near GROUP BY node) USING (node) GROUP BY node")
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees and distinct neighbours."""
    return G.degrees(_edges(spark, d))


@R.query(_E + "SELECT a.entity_type AS from_type, rel, b.entity_type AS to_type, count(*) AS n FROM e JOIN ents a ON a.entity_id = src JOIN ents b ON b.entity_id = dst GROUP BY ALL")
def rel_endpoint_counts(spark: SparkSession, d: str) -> DataFrame:
    """Relations by the types of their ends."""
    t = _entities(spark, d)
    a, b = t.select(F.col("entity_id").alias("src"), F.col("entity_type").alias("from_type")), t.select(F.col("entity_id").alias("dst"), F.col("entity_type").alias("to_type"))
    return _edges(spark, d).join(a, "src").join(b, "dst").groupBy("from_type", "rel", "to_type").agg(F.count("*").alias("n"))


@R.query("""SELECT entity_type, key, count(*) AS n, count(v) AS n_filled FROM (SELECT entity_type, unnest(map_keys(props)) AS key, nullif(unnest(map_values(props)), '') AS v FROM entities) GROUP BY ALL""")
def schema_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the property bags by type."""
    kv = table(spark, d, "entities").select("entity_type", F.explode("props").alias("key", "v"))
    return kv.groupBy("entity_type", "key").agg(F.count("*").alias("n"), F.count(F.nullif("v", F.lit(""))).alias("n_filled"))


@R.query(_E + "SELECT x.src AS project, y.dst AS organization, count(*) AS n, min(x.rel || '/' || y.rel) AS chain FROM e x JOIN e y ON x.dst = y.src JOIN ents p ON p.entity_id = x.src AND p.entity_type = 'project' JOIN ents o ON o.entity_id = y.dst AND o.entity_type = 'organization' GROUP BY ALL")
def two_hop(spark: SparkSession, d: str) -> DataFrame:
    """A pattern of two edges between types, through every node."""
    return _two_hop(spark, d, _edges(spark, d))


def _two_hop(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    """Equal steps are counted before they meet at the middle node."""
    t = _entities(spark, d)
    x = edges.join(t.filter("entity_type = 'project'").select(F.col("entity_id").alias("src")), "src").select("src", F.col("dst").alias("mid"), F.col("rel").alias("r1"))
    y = edges.join(t.filter("entity_type = 'organization'").select(F.col("entity_id").alias("dst")), "dst").select(F.col("src").alias("mid"), "dst", F.col("rel").alias("r2"))
    x = x.groupBy("src", "mid", "r1").agg(F.count("*").alias("n1"))
    y = y.groupBy("mid", "dst", "r2").agg(F.count("*").alias("n2"))
    return G.meet(x, y, "mid", "src").groupBy(F.col("src").alias("project"), F.col("dst").alias("organization")).agg(F.sum(F.col("n1") * F.col("n2")).alias("n"), F.min(F.concat_ws("/", "r1", "r2")).alias("chain"))


@R.query(_E + ", pairs AS (SELECT DISTINCT src, dst FROM e) SELECT a.src AS a, b.src AS b, count(*) AS n_shared FROM pairs a JOIN pairs b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL HAVING count(*) > 1")
def shared_neighbor(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with more than one neighbour in common, however many share it."""
    return _shared_neighbor(_edges(spark, d))


def _shared_neighbor(edges: DataFrame) -> DataFrame:
    p = edges.select("src", "dst").distinct()
    q = p.select(F.col("src").alias("b"), "dst")
    return G.meet(p, q, "dst", "src").filter("src < b").groupBy(F.col("src").alias("a"), "b").agg(F.count("*").alias("n_shared")).filter("n_shared > 1")


@R.query(_E + "SELECT entity_id, entity_type, count(rel) AS n, coalesce(array_to_string(list_sort(list_distinct(list(rel) FILTER (rel IS NOT NULL))), ','), '') AS rels FROM ents LEFT JOIN e ON src = entity_id GROUP BY ALL")
def optional_match(spark: SparkSession, d: str) -> DataFrame:
    """Entities with their relations, if any."""
    e = _edges(spark, d).select(F.col("src").alias("entity_id"), "rel")
    g = _entities(spark, d).join(e, "entity_id", "left").groupBy("entity_id", "entity_type")
    return g.agg(F.count("rel").alias("n"), F.array_join(F.array_sort(F.collect_set("rel")), ",").alias("rels"))


@R.query(_E + "SELECT entity_type, count(*) AS n FROM ents WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = entity_id OR e.dst = entity_id) GROUP BY entity_type")
def not_exists(spark: SparkSession, d: str) -> DataFrame:
    """Entities without edges."""
    e = _edges(spark, d)
    used = e.select(F.col("src").alias("entity_id")).unionByName(e.select(F.col("dst").alias("entity_id"))).distinct()
    return _entities(spark, d).join(used, "entity_id", "left_anti").groupBy("entity_type").agg(F.count("*").alias("n"))


@R.query("""SELECT subject, predicate, object, count(DISTINCT chunk_id) AS n_chunks, round(CAST(max(confidence) AS DOUBLE), 6) AS best, array_to_string(list_sort(list_distinct(list(extraction_run) FILTER (extraction_run IS NOT NULL))), ',') AS runs FROM edges GROUP BY ALL HAVING count(DISTINCT chunk_id) > 1""")
def evidence_agg(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of equal statements, gathered."""
    g = table(spark, d, "edges").groupBy("subject", "predicate", "object")
    return g.agg(F.count_distinct("chunk_id").alias("n_chunks"), F.round(F.max("confidence").cast("double"), 6).alias("best"), F.array_join(F.array_sort(F.collect_set("extraction_run")), ",").alias("runs")).filter("n_chunks > 1")


@R.query(_E.replace("WITH", "WITH RECURSIVE", 1) + """, walk AS (SELECT src AS start, dst AS "end", [src, dst] AS nodes, rel AS rels, 1 AS hops FROM e JOIN ents ON entity_id = src AND entity_type = 'project' WHERE src <> dst
 UNION ALL SELECT w.start, c.dst, list_append(w.nodes, c.dst), w.rels || '/' || c.rel, w.hops + 1 FROM walk w JOIN e c ON c.src = w."end" AND NOT list_contains(w.nodes, c.dst) WHERE w.hops < 3)
 SELECT start, "end", hops, count(*) AS n, min(rels) AS first_chain FROM walk GROUP BY ALL""")
def var_paths_1_3(spark: SparkSession, d: str) -> DataFrame:
    """Paths of one to three edges that pass no node twice."""
    return _var_paths(spark, d, _edges(spark, d))


def _var_paths(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    found = G.paths(edges, _starts(spark, d), 3)
    return found.groupBy("start", "end", "hops").agg(F.count("*").alias("n"), F.min(F.array_join("rels", "/")).alias("first_chain"))


@R.query(_E.replace("WITH", "WITH RECURSIVE", 1) + """, walk AS (SELECT src AS start, dst AS "end", [edge_id] AS ids, 1 AS hops FROM e JOIN ents ON entity_id = src AND entity_type = 'project'
 UNION ALL SELECT w.start, c.dst, list_append(w.ids, c.edge_id), w.hops + 1 FROM walk w JOIN e c ON c.src = w."end" AND NOT list_contains(w.ids, c.edge_id) WHERE w.hops < 3)
 SELECT start, hops, count(*) AS n, count(DISTINCT "end") AS n_ends FROM walk GROUP BY ALL""")
def trails_1_3(spark: SparkSession, d: str) -> DataFrame:
    """Paths that pass no edge twice."""
    return _trails(spark, d, _edges(spark, d))


def _trails(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    found = G.paths(edges, _starts(spark, d), 3, unique="edge")
    return found.groupBy("start", "hops").agg(F.count("*").alias("n"), F.count_distinct("end").alias("n_ends"))


_BFS = _E.replace("WITH", "WITH RECURSIVE", 1) + """, seeds AS (SELECT subject AS node FROM edges WHERE predicate = 'CREATED' OR predicate = 'MENTIONS' GROUP BY subject HAVING count(*) >= 3),
 reach AS (SELECT node, 0 AS r FROM seeds UNION SELECT n.other, reach.r + 1 FROM reach JOIN near n ON n.node = reach.node WHERE reach.r < 3), bfs AS (SELECT node, min(r) AS round FROM reach GROUP BY node) """


def _bfs(spark: SparkSession, d: str, rounds: int = 3) -> DataFrame:
    raw = table(spark, d, "edges").filter("predicate in ('CREATED', 'MENTIONS')")
    seeds = raw.groupBy(F.col("subject").alias("node")).count().filter("count >= 3").select("node")
    return G.expand(_edges(spark, d), seeds, rounds)


@R.query(_BFS + "SELECT node, CAST(round AS BIGINT) AS round FROM bfs")
def bfs_expand(spark: SparkSession, d: str) -> DataFrame:
    """Expansion by three rounds."""
    return _bfs(spark, d).select("node", F.col("round").cast("bigint").alias("round"))


@R.query(_BFS + "SELECT rel, count(*) AS n FROM e WHERE src IN (SELECT node FROM bfs) AND dst IN (SELECT node FROM bfs) GROUP BY rel")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """The edges inside what was reached in three rounds."""
    return _induced(spark, d, 3)


def _induced(spark: SparkSession, d: str, rounds: int) -> DataFrame:
    nodes = _bfs(spark, d, rounds).select("node")
    e = _edges(spark, d)
    inside = e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside.groupBy("rel").agg(F.count("*").alias("n"))


@R.query(_E.replace("WITH", "WITH RECURSIVE", 1) + """,
 reach AS (SELECT DISTINCT node, node AS r FROM near UNION SELECT reach.node, n.other FROM reach JOIN near n ON n.node = reach.r)
 SELECT component, count(*) AS size FROM (SELECT node, min(r) AS component FROM reach GROUP BY node) GROUP BY component""")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    """M8: connected components."""
    return G.components(_edges(spark, d)).groupBy("component").agg(F.count("*").alias("size"))


@R.query()
def communities_lpa(spark: SparkSession, d: str) -> DataFrame:
    """Communities of at least four by label propagation, with their sizes and types."""
    labels = G.label_propagation(_edges(spark, d))
    members = labels.join(_entities(spark, d).withColumnRenamed("entity_id", "node"), "node", "left")
    return members.groupBy("community").agg(F.count("*").alias("size"), F.count_if(F.col("entity_type") == "person").alias("persons"), F.min("label").alias("first_label")).filter("size >= 4")


@R.query()
def communities_modularity(spark: SparkSession, d: str) -> DataFrame:
    """How well the communities part the graph."""
    e = _edges(spark, d)
    return G.modularity(e, G.label_propagation(e))


@R.query(_E + "SELECT x.src AS person, x.dst AS thing, y.dst AS owner FROM e x JOIN e y ON x.dst = y.src AND y.rel = 'BELONGS_TO' WHERE x.rel = 'USES'")
def sparql_bgp(spark: SparkSession, d: str) -> DataFrame:
    """A basic graph pattern of two triples."""
    return _sparql_bgp(_edges(spark, d))


def _sparql_bgp(edges: DataFrame) -> DataFrame:
    x = edges.filter("rel = 'USES'").select(F.col("src").alias("person"), F.col("dst").alias("thing"))
    y = edges.filter("rel = 'BELONGS_TO'").select(F.col("src").alias("thing"), F.col("dst").alias("owner"))
    return G.meet(x, y, "thing", "person").select("person", "thing", "owner")


@R.query(_E + """SELECT p, count(*) AS n, count(DISTINCT o) AS n_objects FROM (SELECT edge_id AS s, unnest(['rdf:subject', 'rdf:predicate', 'rdf:object']) AS p, unnest([src, rel, dst]) AS o FROM e) GROUP BY p""")
def reify(spark: SparkSession, d: str) -> DataFrame:
    """Statements as triples about them."""
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).alias("o")) for p, c in (("rdf:subject", "src"), ("rdf:predicate", "rel"), ("rdf:object", "dst"))))
    return _edges(spark, d).select("edge_id", F.inline(pairs)).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("o").alias("n_objects"))


@R.query(_E + """, topic AS (SELECT dst AS topic, count(DISTINCT src) AS members FROM e GROUP BY dst) SELECT topic, members, row_number() OVER (ORDER BY members DESC, topic) AS place FROM topic QUALIFY members >= 2 OR place <= 3""")
def shared_topics_fill(spark: SparkSession, d: str) -> DataFrame:
    """Objects that at least two subjects share, filled up to three."""
    return _shared_topics(spark, d, 2)


def _shared_topics(spark: SparkSession, d: str, least: int) -> DataFrame:
    t = _edges(spark, d).groupBy(F.col("dst").alias("topic")).agg(F.count_distinct("src").alias("members"))
    top = t.orderBy(F.desc("members"), "topic").limit(3)
    kept = t.filter(F.col("members") >= least).unionByName(top).distinct()
    return rank.numbered(kept, [F.desc("members"), F.col("topic")], "place")


@R.query(_E + "SELECT '<' || src || '> <' || rel || '> <' || dst || '> .' AS line FROM e")
def turtle_lines(spark: SparkSession, d: str) -> DataFrame:
    """A line per triple."""
    return _edges(spark, d).select(F.format_string("<%s> <%s> <%s> .", "src", "rel", "dst").alias("line"))


_ONTO = [("USES", "project", "organization"), ("USES", "person", "project"), ("BELONGS_TO", "person", "organization"), ("BELONGS_TO", "project", "organization"), ("WORKED_ON", "person", "project"), ("MENTIONS", "person", "person")]
_ONTO_SQL = ", ".join(str(x) for x in _ONTO)


@R.query(f"""WITH onto(predicate, domain, "range") AS (VALUES {_ONTO_SQL}), rules AS (SELECT predicate, list(domain) AS domains, list("range") AS ranges FROM onto GROUP BY predicate),
 ents AS (SELECT entity_id, min(entity_type) AS entity_type FROM entities GROUP BY entity_id), t AS (SELECT id, min(content) AS text FROM document_chunks GROUP BY id),
 e AS (SELECT DISTINCT id, subject, predicate, object, chunk_id, evidence FROM edges)
 SELECT predicate, reason, count(*) AS n FROM (SELECT e.predicate, CASE WHEN domains IS NULL THEN 'unknown_predicate' WHEN s.entity_type IS NULL THEN 'dangling_subject' WHEN o.entity_type IS NULL THEN 'dangling_object'
  WHEN NOT coalesce(contains(trim(regexp_replace(t.text, '[\\s\\x{{00A0}}]+', ' ', 'g'), ' '), trim(regexp_replace(e.evidence, '[\\s\\x{{00A0}}]+', ' ', 'g'), ' ')), false) THEN 'evidence_not_found'
  WHEN NOT list_contains(domains, s.entity_type) THEN 'domain_mismatch' WHEN NOT list_contains(ranges, o.entity_type) THEN 'range_mismatch' END AS reason
 FROM e LEFT JOIN rules USING (predicate) LEFT JOIN ents s ON s.entity_id = subject LEFT JOIN ents o ON o.entity_id = object LEFT JOIN t ON t.id = chunk_id) GROUP BY ALL""")
def triple_validate(spark: SparkSession, d: str) -> DataFrame:
    """The first reason for which statements fail, counted."""
    triples = table(spark, d, "edges").select(F.col("id").alias("edge_id"), "subject", "predicate", "object", "chunk_id", "evidence").distinct()
    texts = table(spark, d, "document_chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.min("content").alias("text"))
    schema = spark.createDataFrame(_ONTO, "predicate string, domain string, range string")
    checked = K.validate_triples(triples, _entities(spark, d).select("entity_id", "entity_type"), schema, texts)
    return checked.groupBy("predicate", "reason").agg(F.count("*").alias("n"))


@R.query("""SELECT rule, count(*) AS n FROM (SELECT DISTINCT * FROM (
 SELECT 'duplicate_entity' AS rule, entity_id AS key FROM entities GROUP BY entity_id HAVING count(*) > 1
 UNION ALL SELECT 'duplicate_edge', CAST(min(id) AS VARCHAR) FROM edges GROUP BY subject, predicate, object, chunk_id HAVING count(*) > 1
 UNION ALL SELECT 'dangling', CAST(id AS VARCHAR) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM entities n WHERE n.entity_id = e.subject)
 UNION ALL SELECT 'no_provenance', CAST(id AS VARCHAR) FROM edges WHERE chunk_id IS NULL OR trim(chunk_id, ' ') = ''
 UNION ALL SELECT 'bad_confidence', CAST(id AS VARCHAR) FROM edges WHERE confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1
 UNION ALL SELECT 'self_loop', CAST(id AS VARCHAR) FROM edges WHERE subject = object)) GROUP BY rule""")
def graph_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the graph breaks."""
    return K.integrity(table(spark, d, "entities"), table(spark, d, "edges")).groupBy("rule").agg(F.count("*").alias("n"))


@R.query("""SELECT id, CAST(strpos(content, evidence) - 1 AS BIGINT) AS start_at FROM (SELECT DISTINCT e.id, e.evidence, c.content FROM edges e JOIN document_chunks c ON c.id = e.chunk_id) WHERE contains(content, evidence)""")
def fact_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the evidence stands in its chunk."""
    e = table(spark, d, "edges").select("id", "chunk_id", "evidence").distinct()
    c = table(spark, d, "document_chunks").select(F.col("id").alias("chunk_id"), "content")
    j = e.join(c, "chunk_id").filter(F.contains("content", "evidence")).select("id", (F.expr("instr(content, evidence)") - 1).cast("bigint").alias("start_at"))
    return j.distinct()


@R.query("""SELECT lower(label) AS name, entity_type, count(DISTINCT entity_id) AS n FROM entities GROUP BY ALL HAVING count(DISTINCT entity_id) > 1""")
def dup_labels(spark: SparkSession, d: str) -> DataFrame:
    """A2: labels that several entities have."""
    return table(spark, d, "entities").groupBy(F.lower("label").alias("name"), "entity_type").agg(F.count_distinct("entity_id").alias("n")).filter("n > 1")


@R.query("""SELECT id AS key, min(id) OVER (PARTITION BY sha256(trim(regexp_replace(content, '[\\s\\x{00A0}]+', ' ', 'g'), ' '))) AS canonical FROM document_chunks WHERE content IS NOT NULL""")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """M1: the canonical id of equal contents."""
    return K.canonical_rows(table(spark, d, "document_chunks"), "id", "content")


_MERGE = """WITH e AS (SELECT id AS edge_id, subject AS src, predicate AS rel, object AS dst FROM (SELECT DISTINCT id, subject, predicate, object FROM edges) WHERE object IS NOT NULL AND regexp_matches(object, '\\S')),
 map AS (SELECT DISTINCT entity_id AS node, min(entity_id) OVER (PARTITION BY lower(label), entity_type) AS canonical FROM entities),
 moved AS (SELECT edge_id, coalesce(a.canonical, src) AS src, rel, coalesce(b.canonical, dst) AS dst FROM e LEFT JOIN (SELECT node, min(canonical) AS canonical FROM map GROUP BY node) a ON a.node = src LEFT JOIN (SELECT node, min(canonical) AS canonical FROM map GROUP BY node) b ON b.node = dst),
 kept AS (SELECT src, rel, dst, min(edge_id) AS edge_id, count(*) AS n FROM moved WHERE src <> dst GROUP BY ALL) """


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    named = table(spark, d, "entities").select("entity_id", F.lower("label").alias("name"), "entity_type")
    least = named.groupBy("name", "entity_type").agg(F.min("entity_id").alias("canonical"))
    same = named["name"].eqNullSafe(least["name"]) & named["entity_type"].eqNullSafe(least["entity_type"])
    mapping = named.join(least, same).groupBy(F.col("entity_id").alias("node")).agg(F.min("canonical").alias("canonical"))
    return K.apply_merge(_edges(spark, d), mapping)


@R.query(_MERGE + "SELECT edge_id, src, rel, dst FROM kept")
def remap_edges(spark: SparkSession, d: str) -> DataFrame:
    """M9: edges after merging entities of equal labels."""
    return _merged(spark, d)[0]


@R.query(_MERGE + "SELECT m.edge_id, k.edge_id AS kept_id FROM moved m JOIN kept k USING (src, rel, dst) WHERE m.edge_id <> k.edge_id")
def merge_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Edges that fall together in the merge."""
    return _merged(spark, d)[1]


@R.query("""SELECT l_partkey, l_suppkey, signature, dense_rank() OVER (PARTITION BY l_partkey ORDER BY signature) AS number FROM (SELECT DISTINCT l_partkey, l_suppkey, l_suppkey || ':' || l_returnflag AS signature FROM lineitem)""")
def use_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the uses of a part by their signature."""
    uses = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.concat_ws(":", F.col("l_suppkey").cast("string"), "l_returnflag").alias("signature")).distinct()
    return K.numbered(uses, ["l_partkey"], ["signature"])


@R.query("""SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY ALL HAVING count(*) > 1""")
def blocking(spark: SparkSession, d: str) -> DataFrame:
    """M6: blocks of more than one."""
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).filter("n > 1")


@R.query("""SELECT id, name FROM (SELECT id, arg_max(name, loaded_at) AS name FROM kg_entities GROUP BY id)""")
def latest_merge(spark: SparkSession, d: str) -> DataFrame:
    """The latest period's row of each id."""
    return K.latest_of(table(spark, d, "kg_entities").select("id", "name", "loaded_at"), ["id"], ["loaded_at"]).select("id", "name")


@R.query("""SELECT id, min(name) AS name, count(*) AS n FROM (SELECT id, name FROM kg_entities WHERE deleted_at IS NULL UNION ALL SELECT id, name FROM kg_entities k WHERE deleted_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kg_entities o WHERE o.id = k.id AND o.deleted_at IS NULL)) GROUP BY id""")
def upsert_present(spark: SparkSession, d: str) -> DataFrame:
    """Insert what isn't there yet, leave what is."""
    k = table(spark, d, "kg_entities")
    merged = K.upsert(k.filter("deleted_at is null").select("id", "name"), k.filter("deleted_at is not null").select("id", "name"), ["id"], update=False)
    return merged.groupBy("id").agg(F.min("name").alias("name"), F.count("*").alias("n"))


@R.query("""WITH h AS (SELECT source, sha256(content) AS h FROM document_chunks WHERE content IS NOT NULL), a AS (SELECT source, h[1:5] AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY ALL),
 b AS (SELECT source, p[1:2] AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h FROM a GROUP BY ALL) SELECT source, sha256(string_agg(h, chr(10) ORDER BY p)) AS fingerprint FROM b GROUP BY source""")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A hash over the ordered hashes of a source, by ranges of five and two digits, so that no list
    holds more than a millionth of the hashes or 4,096 of ranges."""
    level = table(spark, d, "document_chunks").filter("content is not null").select("source", F.sha2("content", 256).alias("h"), F.sha2("content", 256).alias("o"))
    for digits in (5, 2, 0):
        own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "\n")
        level = level.groupBy("source", F.left("o", F.lit(digits)).alias("p")).agg(F.sha2(own, 256).alias("h")).withColumnRenamed("p", "o")
    return level.select("source", F.col("h").alias("fingerprint"))


@R.query("""SELECT a.id, a.name, CASE WHEN lower(a.name) = a.normalized_name THEN 'matched' WHEN a.normalized_name IS NULL THEN 'missing' ELSE 'different' END AS state FROM (SELECT DISTINCT id, name, normalized_name FROM kg_entities) a""")
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """M3: names against their stored normal form."""
    df = table(spark, d, "kg_entities").select("id", "name", "normalized_name").distinct()
    state = F.when(F.lower("name") == F.col("normalized_name"), "matched").when(F.col("normalized_name").isNull(), "missing").otherwise("different")
    return df.select("id", "name", state.alias("state"))


@R.query("""SELECT id, left(sha256(coalesce(subject_id, '') || chr(31) || coalesce(predicate, '') || chr(31) || coalesce(object_id, object_literal, '')), 24) AS key FROM (SELECT DISTINCT id, subject_id, predicate, object_id, object_literal FROM kg_edges)""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """M4: edge ids from their parts."""
    e = table(spark, d, "kg_edges").select("id", "subject_id", "predicate", "object_id", "object_literal").distinct()
    text = lambda *c: F.coalesce(*c, F.lit(""))
    return e.select("id", K.stable_id(text("subject_id"), text("predicate"), text("object_id", "object_literal")).alias("key"))


@R.query("""SELECT subject_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(predicate || '=' || object_literal))), ' | ') AS literals FROM (SELECT DISTINCT * FROM kg_edges WHERE object_literal IS NOT NULL) GROUP BY subject_id""")
def literal_properties(spark: SparkSession, d: str) -> DataFrame:
    """Literals of nodes as properties."""
    e = table(spark, d, "kg_edges").filter("object_literal is not null").distinct()
    return e.groupBy("subject_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "predicate", "object_literal"))), " | ").alias("literals"))
