"""Further queries: chat lines, hints, recommendations, audits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.functions import text as X
from quernlake.operators import graph as G
from quernlake.operators import knowledge as K
from quernlake.operators import ranking as rank
from quernlake.plans.graph import _E, _edges, _entities
from quernlake.plans.registry import Registry
from quernlake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""WITH l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM chunks WHERE text IS NOT NULL),
 m AS (SELECT *, sum(CAST(regexp_matches(line, '^[^:\\[\\n]{1,40}: ') AS INT)) OVER (PARTITION BY id ORDER BY i) AS k FROM l WHERE i > 1)
 SELECT id, CAST(k AS BIGINT) AS message_no, regexp_extract(arg_min(line, i), '^([^:\\[\\n]{1,40}): ', 1) AS speaker, count(*) AS n_lines FROM m WHERE k > 0 GROUP BY id, k""")
def chat_line_parse(spark: SparkSession, d: str) -> DataFrame:
    """Lines of chunks put together to messages; a line without a speaker goes on with the last.
    Everything happens in the row: a fold over its lines, no exchange."""
    lines = F.slice(F.split("text", "\n"), F.lit(2), F.greatest(F.size(F.split("text", "\n")) - 1, F.lit(0)))
    none = F.array().cast("array<struct<speaker:string,n_lines:bigint>>")

    def step(done, line):
        speaker = F.regexp_extract(line, r"^([^:\[\n]{1,40}): ", 1)
        new = F.struct(speaker.alias("speaker"), F.lit(1).cast("bigint").alias("n_lines"))
        last = F.get(done, F.size(done) - 1)
        more = F.struct(last["speaker"].alias("speaker"), (last["n_lines"] + 1).alias("n_lines"))
        begun = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(more))
        return F.when(line.rlike(r"^[^:\[\n]{1,40}: "), F.array_append(done, new)).when(F.size(done) > 0, begun).otherwise(done)

    found = table(spark, d, "chunks").filter("text is not null").select("id", F.posexplode(F.aggregate(lines, none, step)).alias("k", "m"))
    return found.select("id", (F.col("k") + 1).cast("bigint").alias("message_no"), "m.speaker", "m.n_lines")


@R.query("""SELECT doc_id, regexp_replace(substr(text, greatest(1, strpos(lower(text), 'rollback') - 40), 120), '(?i)(rollback)', '«\\1»', 'g') AS fragment FROM documents WHERE contains(lower(text), 'rollback')""")
def highlight(spark: SparkSession, d: str) -> DataFrame:
    """The place of a match with marks."""
    docs = table(spark, d, "documents").filter(F.lower("text").contains("rollback"))
    part = F.substring("text", F.greatest(F.lit(1), F.expr("instr(lower(text), 'rollback')") - 40), F.lit(120))
    return docs.select("doc_id", F.regexp_replace(part, "(?i)(rollback)", "«$1»").alias("fragment"))


@R.query("""SELECT doc_id, array_to_string([chr(34) || x || chr(34) FOR x IN regexp_extract_all(lower(title), '[0-9A-Za-z가-힣]+')], ' OR ') AS query FROM documents WHERE title IS NOT NULL""")
def query_strings(spark: SparkSession, d: str) -> DataFrame:
    """Words as a query of quoted alternatives."""
    q = F.array_join(F.transform(X.words(F.col("title")), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")
    return table(spark, d, "documents").filter("title is not null").select("doc_id", q.alias("query"))


@R.query("""WITH s AS (SELECT member_id, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY member_id HAVING count(*) >= 3),
 r AS (SELECT member_id, row_number() OVER (ORDER BY n DESC, member_id) AS rn, row_number() OVER (ORDER BY chars DESC, member_id) AS rc FROM s)
 SELECT member_id, round(1.0 / (60 + rn) + 1.0 / (60 + rc), 9) AS score FROM r""")
def popularity_rrf(spark: SparkSession, d: str) -> DataFrame:
    """two signals of popularity fused by rank, among those that qualify."""
    s = table(spark, d, "documents").groupBy("member_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).filter("n >= 3")
    ranked = rank.numbered(rank.numbered(s, [F.desc("n"), F.col("member_id")], "rn"), [F.desc("chars"), F.col("member_id")], "rc")
    return ranked.select("member_id", F.round(1.0 / (60 + F.col("rn")) + 1.0 / (60 + F.col("rc")), 9).alias("score"))


@R.query(_E + """SELECT edge_id, CAST(3 * CAST(contains(lower(x.evidence), lower(a.label)) AS INT) + 3 * CAST(contains(lower(x.evidence), lower(b.label)) AS INT) + 2 * CAST(c.id IS NOT NULL AS INT) AS BIGINT) AS score
 FROM (SELECT DISTINCT id AS edge_id, subject, object, chunk_id, evidence FROM edges) x JOIN ents a ON a.entity_id = subject JOIN ents b ON b.entity_id = object LEFT JOIN (SELECT DISTINCT id FROM document_chunks WHERE contains(content, '점검') OR contains(content, 'plan')) c ON c.id = x.chunk_id""")
def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    """points for a chunk that was found and for names that the evidence mentions."""
    e = table(spark, d, "edges").select(F.col("id").alias("edge_id"), "subject", "object", "chunk_id", "evidence").distinct()
    t = _entities(spark, d)
    a, b = t.select(F.col("entity_id").alias("subject"), F.lower("label").alias("la")), t.select(F.col("entity_id").alias("object"), F.lower("label").alias("lb"))
    hit = table(spark, d, "document_chunks").filter(F.contains("content", F.lit("점검")) | F.contains("content", F.lit("plan"))).select(F.col("id").alias("chunk_id"), F.lit(1).alias("hit")).distinct()
    j = e.join(a, "subject").join(b, "object").join(hit, "chunk_id", "left")
    named = lambda c: F.coalesce(F.contains(F.lower("evidence"), F.col(c)).cast("int"), F.lit(None))
    return j.select("edge_id", (3 * named("la") + 3 * named("lb") + 2 * F.coalesce("hit", F.lit(0))).cast("bigint").alias("score"))


@R.query("""SELECT id, arg_min(normalized_name, loaded_at) FILTER (normalized_name IS NOT NULL) AS normalized_name, count(*) AS n FROM kg_entities GROUP BY id""")
def first_non_null(spark: SparkSession, d: str) -> DataFrame:
    """The first value that is there."""
    first = F.min_by("normalized_name", F.when(F.col("normalized_name").isNotNull(), F.col("loaded_at")))
    return table(spark, d, "kg_entities").groupBy("id").agg(first.alias("normalized_name"), F.count("*").alias("n"))


@R.query("""WITH e AS (SELECT entity_id, min(loaded_at) AS t FROM entities GROUP BY entity_id), old AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) AS number FROM e WHERE t < TIMESTAMPTZ '2015-01-15 00:00:00+00')
 SELECT entity_id, number FROM old UNION ALL SELECT entity_id, (SELECT max(number) FROM old) + row_number() OVER (ORDER BY t, entity_id) FROM e WHERE t >= TIMESTAMPTZ '2015-01-15 00:00:00+00'""")
def appended_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that are given stay, new ones follow by date."""
    e = table(spark, d, "entities").groupBy("entity_id").agg(F.min("loaded_at").alias("t"))
    new = F.col("t") >= F.lit("2015-01-15 00:00:00").cast("timestamp")
    order = [F.col("new"), F.when(F.col("new"), F.col("t")), F.col("entity_id")]
    return rank.numbered(e.withColumn("new", new), order, "number").select("entity_id", "number")


@R.query(_E + """, gone AS (SELECT entity_id FROM entities GROUP BY entity_id HAVING count(*) = count(deleted_at)) SELECT rel, count(*) AS n_lost, count(DISTINCT src) AS n_subjects FROM e WHERE src IN (SELECT entity_id FROM gone) OR dst IN (SELECT entity_id FROM gone) GROUP BY rel""")
def delete_audit(spark: SparkSession, d: str) -> DataFrame:
    """Relations that would go with deleted entities."""
    gone = table(spark, d, "entities").groupBy("entity_id").agg(F.count("*").alias("n"), F.count("deleted_at").alias("k")).filter("n = k")
    e = _edges(spark, d)
    src, dst = gone.select(F.col("entity_id").alias("src"), F.lit(1).alias("a")), gone.select(F.col("entity_id").alias("dst"), F.lit(1).alias("b"))
    lost = e.join(src, "src", "left").join(dst, "dst", "left").filter("a = 1 or b = 1")
    return lost.groupBy("rel").agg(F.count("*").alias("n_lost"), F.count_distinct("src").alias("n_subjects"))


@R.query("""WITH u AS (SELECT lower(label) AS name, entity_id AS id, 'entities' AS corpus, 0 AS o FROM entities WHERE label IS NOT NULL UNION ALL SELECT lower(name), id, 'kg_entities', 1 FROM kg_entities WHERE name IS NOT NULL)
 SELECT name, arg_min(id, (o, id)) AS id, array_to_string(list_sort(list_distinct(list(corpus))), ',') AS corpora FROM u GROUP BY name""")
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    """Corpora by name; the first wins, all are named."""
    a = table(spark, d, "entities").select(F.lower("label").alias("name"), F.col("entity_id").alias("id"), F.lit("entities").alias("corpus"), F.lit(0).alias("o"))
    b = table(spark, d, "kg_entities").select(F.lower("name").alias("name"), "id", F.lit("kg_entities").alias("corpus"), F.lit(1).alias("o"))
    g = a.unionByName(b).filter("name is not null").groupBy("name")
    return g.agg(F.min_by("id", F.struct("o", "id")).alias("id"), F.array_join(F.array_sort(F.collect_set("corpus")), ",").alias("corpora"))


@R.query(_E + """, deg AS (SELECT node, count(*) AS k FROM near GROUP BY node) SELECT node, other, k AS degree, place FROM (SELECT n.node, n.other, d.k, row_number() OVER (PARTITION BY n.node ORDER BY d.k DESC, n.other) AS place FROM near n JOIN deg d ON d.node = n.other) WHERE place <= 5""")
def neighbour_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The five neighbours of each node with most neighbours."""
    near = G.undirected(_edges(spark, d))
    deg = near.groupBy(F.col("node").alias("other")).agg(F.count("*").alias("degree"))
    top = rank.top_k(near.join(deg, "other"), ["node"], [F.desc("degree"), F.col("other")], 5, "other", rank="place")
    return top.select("node", "other", "degree", "place")


@R.query(_E + """, p AS (SELECT DISTINCT src, dst FROM e), cand AS (SELECT a.src AS node, c.dst AS suggestion, count(DISTINCT a.dst) AS n_shared FROM p a JOIN p b ON a.dst = b.dst AND a.src <> b.src JOIN p c ON c.src = b.src AND c.dst <> a.src
  WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.src = a.src AND o.dst = c.dst) GROUP BY ALL)
 SELECT node, suggestion, n_shared, place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n_shared DESC, suggestion) AS place FROM cand) WHERE place <= 3""")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """What nodes with a common neighbour have and a node has not, through every node."""
    return _recommendations(_edges(spark, d))


def _recommendations(edges: DataFrame) -> DataFrame:
    p = edges.select("src", "dst").distinct()
    b = p.select(F.col("src").alias("peer"), "dst")
    shared = G.meet(p, b, "dst", "src").filter("src <> peer")
    c = p.select(F.col("src").alias("peer"), F.col("dst").alias("suggestion"))
    found = G.meet(shared, c, "peer", "src").filter("suggestion <> src").join(p.select("src", F.col("dst").alias("suggestion")), ["src", "suggestion"], "left_anti")
    counted = found.groupBy(F.col("src").alias("node"), "suggestion").agg(F.count_distinct("dst").alias("n_shared"))
    top = rank.top_k(counted, ["node"], [F.desc("n_shared"), F.col("suggestion")], 3, "suggestion", rank="place")
    return top.select("node", "suggestion", "n_shared", "place")


@R.query(_E + """SELECT src, rel, left(string_agg(DISTINCT dst, ', ' ORDER BY dst), 800) AS facts, count(DISTINCT dst) AS n FROM e GROUP BY src, rel""")
def fact_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a node by relation, up to 800 characters."""
    g = _edges(spark, d).groupBy("src", "rel").agg(F.array_sort(F.collect_set("dst")).alias("o"))
    return g.select("src", "rel", F.left(F.array_join("o", ", "), F.lit(800)).alias("facts"), F.size("o").cast("bigint").alias("n"))


@R.query("""SELECT 'repeated' AS rule, CAST(doc_id AS VARCHAR) AS key FROM subject_labels GROUP BY doc_id, area HAVING count(*) > 1
 UNION SELECT 'unknown_document', CAST(doc_id AS VARCHAR) FROM subject_labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
 UNION SELECT 'unknown_area', area FROM subject_labels l WHERE area IS NOT NULL AND NOT EXISTS (SELECT 1 FROM subject_areas a WHERE a.area = l.area)
 UNION SELECT 'none_and_some', CAST(doc_id AS VARCHAR) FROM subject_labels GROUP BY doc_id HAVING count(area) > 0 AND count(*) > count(area)""")
def label_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Labels that contradict each other or the corpus."""
    labels = table(spark, d, "subject_labels")
    key = F.col("doc_id").cast("string").alias("key")
    twice = labels.groupBy("doc_id", "area").count().filter("count > 1").select(F.lit("repeated").alias("rule"), key)
    lost = labels.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti").select(F.lit("unknown_document").alias("rule"), key)
    strange = labels.filter("area is not null").join(table(spark, d, "subject_areas").select("area"), "area", "left_anti").select(F.lit("unknown_area").alias("rule"), F.col("area").alias("key"))
    mixed = labels.groupBy("doc_id").agg(F.count("area").alias("k"), F.count("*").alias("n")).filter("k > 0 and n > k").select(F.lit("none_and_some").alias("rule"), key)
    return twice.unionByName(lost).unionByName(strange).unionByName(mixed).distinct()


@R.query("""SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(GROUPING(source) * 2 + GROUPING(lang) AS BIGINT) AS level FROM documents GROUP BY CUBE (source, lang)""")
def corpus_cube(spark: SparkSession, d: str) -> DataFrame:
    """All groupings of two dimensions in one pass."""
    return table(spark, d, "documents").cube("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("bigint").alias("level"))


@R.query("""SELECT doc_id, array_to_string(t[:5], ',') AS tags FROM (SELECT doc_id, list_filter(list_concat([lower(source)], [lower(lang)]), lambda x: x IS NOT NULL) AS t FROM documents)""")
def merged_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of two origins, up to five."""
    both = F.filter(F.array(F.lower("source"), F.lower("lang")), lambda x: x.isNotNull())
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(both, 1, 5), ",").alias("tags"))


@R.query("""SELECT 'C' || lpad(CAST(row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS VARCHAR), 5, '0') AS code, doc_id FROM documents WHERE source = 'repo'""")
def blinded_pool(spark: SparkSession, d: str) -> DataFrame:
    """A pool for judging under codes that don't tell the order."""
    pool = table(spark, d, "documents").filter("source = 'repo'").select("doc_id")
    coded = rank.numbered(pool, [F.md5(F.col("doc_id").cast("string"))], "code")
    return coded.select(F.concat(F.lit("C"), F.lpad(F.col("code").cast("string"), 5, "0")).alias("code"), "doc_id")


@R.query("""SELECT t.room_id, t.name, count(m.id) AS n_messages, coalesce(any_value(t.speaker_role), 'unknown') AS role FROM (SELECT room_id, id, min(name) AS name, min(speaker_role) AS speaker_role FROM members GROUP BY ALL) t LEFT JOIN messages m ON m.room_id = t.room_id AND m.sender_id = t.id GROUP BY t.room_id, t.id, t.name""")
def member_totals(spark: SparkSession, d: str) -> DataFrame:
    """Members with their messages, counted before the join."""
    said = table(spark, d, "messages").filter("sender_id is not null").groupBy("room_id", F.col("sender_id").alias("id")).agg(F.count("*").alias("n"))
    who = table(spark, d, "members").groupBy("room_id", "id").agg(F.min("name").alias("name"), F.min("speaker_role").alias("r"))
    return who.join(said, ["room_id", "id"], "left").select("room_id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_messages"), F.coalesce("r", F.lit("unknown")).alias("role"))


@R.query("""SELECT edge_id, count(*) AS n_evidence, count(DISTINCT chunk_id) AS n_chunks, min(source) AS source, max(evidence) AS last_evidence FROM (SELECT DISTINCT id, edge_id, chunk_id, source, evidence FROM kg_evidence) GROUP BY edge_id""")
def evidence_hydration(spark: SparkSession, d: str) -> DataFrame:
    """Z3: evidence of edges, each delivered row once."""
    e = table(spark, d, "kg_evidence").select("id", "edge_id", "chunk_id", "source", "evidence").distinct()
    return e.groupBy("edge_id").agg(F.count("*").alias("n_evidence"), F.count_distinct("chunk_id").alias("n_chunks"), F.min("source").alias("source"), F.max("evidence").alias("last_evidence"))


@R.query("""SELECT k.id, k.name, coalesce(c.n, 0) AS n_edges FROM (SELECT id, min(name) AS name FROM kg_entities GROUP BY id) k LEFT JOIN (SELECT node, count(*) AS n FROM (SELECT DISTINCT id, subject_id AS node FROM kg_edges UNION SELECT DISTINCT id, object_id FROM kg_edges) GROUP BY node) c ON c.node = k.id""")
def store_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Entities against the edges that name them."""
    e = table(spark, d, "kg_edges")
    ends = e.select("id", F.col("subject_id").alias("node")).unionByName(e.select("id", F.col("object_id").alias("node"))).distinct().filter("node is not null")
    n = ends.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n"))
    return table(spark, d, "kg_entities").groupBy("id").agg(F.min("name").alias("name")).join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_edges"))


@R.query()
def knn_lsh(spark: SparkSession, d: str) -> DataFrame:
    """V5: approximate neighbours of every vector whose id is divisible by 50, by random projections:
    rows that share a bucket in any hash table are compared; hot buckets are dealt out."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="v").transform(data)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=8, seed=3).fit(unit)
    hashed = model.transform(unit).select("id", F.posexplode("h").alias("t", "b"))
    buckets = hashed.select("id", F.concat_ws(":", "t", vector_to_array("b")[0].cast("bigint")).alias("bucket"))
    asked = buckets.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "bucket")
    pairs = G.meet(buckets, asked, "bucket", "id").filter("id <> query_id").select("query_id", "id").distinct()
    vectors = unit.select("id", vector_to_array("v").alias("x"))
    held = pairs.join(vectors, "id").join(vectors.select(F.col("id").alias("query_id"), F.col("x").alias("y")), "query_id")
    distance = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, z: t + z))
    far = held.select("query_id", "id", F.round(distance, 6).alias("distance"))
    return rank.top_k(far, ["query_id"], [F.col("distance"), F.col("id")], 10, "id").select("query_id", "id", "distance", "rank")


@R.query("""SELECT id, name, coalesce(alias, name) AS canonical FROM (SELECT id, min(lower(name)) AS name FROM kg_entities GROUP BY id) LEFT JOIN (SELECT regexp_replace(lower(name), ',? ?(inc|co|ltd)\\.', '', 'g') AS alias, lower(name) AS name FROM (SELECT DISTINCT name FROM kg_entities WHERE entity_type = 'organization') GROUP BY ALL) USING (name)""")
def canonical_label(spark: SparkSession, d: str) -> DataFrame:
    """M2: labels by a table of aliases."""
    k = table(spark, d, "kg_entities")
    names = k.filter("entity_type = 'organization' and name is not null").select(F.lower("name").alias("name")).distinct()
    alias = names.select("name", F.regexp_replace("name", r",? ?(inc|co|ltd)\.", "").alias("alias"))
    each = k.groupBy("id").agg(F.min(F.lower("name")).alias("name"))
    return each.join(alias, "name", "left").select("id", "name", F.coalesce("alias", "name").alias("canonical"))


@R.query("""SELECT id, subject_id, predicate FROM (SELECT DISTINCT id, subject_id, predicate, object_id FROM kg_edges) e WHERE object_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.predicate = e.predicate AND x.subject = e.subject_id)""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Edges of one store that the other doesn't know."""
    e = table(spark, d, "kg_edges").filter("object_id is not null").select("id", "subject_id", "predicate", "object_id").distinct()
    known = table(spark, d, "edges").select(F.col("subject").alias("subject_id"), "predicate").distinct()
    return e.join(known, ["subject_id", "predicate"], "left_anti").select("id", "subject_id", "predicate")


@R.query()
def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each chunk id."""
    rows = table(spark, d, "document_chunks").select("id", "page_id", "title", "source", "loaded_at")
    return K.latest_of(rows, ["id"], ["loaded_at"])
