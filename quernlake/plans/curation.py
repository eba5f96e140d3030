"""Queries of curating a graph and a corpus: identity, structure, overlays, reviews, and their texts."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.functions import commits
from quernlake.functions import text as X
from quernlake.operators import graph as G
from quernlake.operators import knowledge as K
from quernlake.operators.ordered import last_before
from quernlake.operators.versions import Versions, remembered
from quernlake.plans.graph import _E, _edges
from quernlake.plans.registry import Registry
from quernlake.session import cut, scratch_dir, table
from quernlake.sources import files
from quernlake.streaming.sessions import upsert_batches

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


_FLAT = "trim(regexp_replace(evidence, '[\\s\\x{00A0}]+', ' ', 'g'), ' ')"


@R.query(f"""WITH u AS (SELECT DISTINCT id, predicate, object, chunk_id, {_FLAT} AS said FROM edges WHERE chunk_id IS NOT NULL AND evidence IS NOT NULL AND object IS NOT NULL), f AS (SELECT *, min(id) OVER (PARTITION BY predicate, object, chunk_id, said) AS first FROM u)
 SELECT DISTINCT first AS id_a, id AS id_b FROM f WHERE first <> id""")
def pair_rule(spark: SparkSession, d: str) -> DataFrame:
    """M7: uses in one block are the same if they share a chunk and its words; each with the first of them."""
    e = table(spark, d, "edges").filter("chunk_id is not null and evidence is not null and object is not null")
    u = e.select("id", "predicate", "object", "chunk_id", X.squeeze(F.col("evidence")).alias("said")).distinct()
    block = ["predicate", "object", "chunk_id", "said"]
    first = u.groupBy(*block).agg(F.min("id").alias("id_a"), F.count("*").alias("n")).filter("n > 1")
    return u.join(first, block).filter("id <> id_a").select("id_a", F.col("id").alias("id_b")).distinct()


@R.query(_E.replace("WITH", "WITH RECURSIVE", 1) + """, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE rel = 'BELONGS_TO' AND src <> dst), ways AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
 reach AS (SELECT DISTINCT a AS node, a AS r FROM ways UNION SELECT reach.node, b FROM reach JOIN ways ON a = reach.r), g AS (SELECT node, min(r) AS component FROM reach GROUP BY node), s AS (SELECT component, count(*) AS size FROM g GROUP BY component)
 SELECT s.component, size, count(p.a) = size * (size - 1) / 2 AS is_clique FROM s JOIN g USING (component) LEFT JOIN p ON p.a = g.node GROUP BY s.component, size""")
def clique_merge(spark: SparkSession, d: str) -> DataFrame:
    """M8: groups that judged pairs connect, and whether every two of a group were judged the same; only
    those may be merged."""
    e = _edges(spark, d).filter("rel = 'BELONGS_TO' and src <> dst")
    pairs = cut(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "pairs")
    return G.cliques(pairs, G.components(e))


@R.query("""SELECT 'before' AS step, count(*) AS n FROM (SELECT DISTINCT id, subject, predicate, object FROM edges) UNION ALL SELECT 'applied', count(*) FROM (SELECT DISTINCT subject, predicate, object FROM edges) UNION ALL SELECT 'undone', count(*) FROM (SELECT DISTINCT id, subject, predicate, object FROM edges)""")
def merge_apply_undo(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot, plan, apply (twice is once) and undo, each guarded by the hash of what it is for."""
    v = Versions(spark, _place(spark, "versions"))
    e = table(spark, d, "edges").select("id", "subject", "predicate", "object").distinct()
    first = v.snapshot(e)
    merged = v.read().groupBy("subject", "predicate", "object").agg(F.min("id").alias("id"))
    numbers = [("before", 0)]
    v.apply(merged, first, "merge equal statements")
    numbers.append(("applied", v.apply(merged, first, "merge equal statements")))
    numbers.append(("undone", v.undo("merge equal statements")))
    parts = [v.read(k).agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "n") for step, k in numbers]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query("""SELECT name, n, (SELECT count(DISTINCT content) FROM document_chunks) AS n_computed FROM (SELECT 'words' AS name, CAST(sum(len(regexp_extract_all(lower(content), '[0-9A-Za-z가-힣]+'))) AS BIGINT) AS n FROM document_chunks)""")
def memo_counts(spark: SparkSession, d: str) -> DataFrame:
    """A costly function of texts asked for twice and computed once a content."""
    path = _place(spark, "memo")
    rows = table(spark, d, "document_chunks").select("id", "content")
    count = lambda df: df.select("_key", F.size(X.words(F.col("content"))).alias("n_words"))
    remembered(rows, "content", count, path)
    answered = remembered(rows, "content", count, path)
    computed = spark.read.parquet(path).agg(F.count("*").alias("n_computed"))
    total = answered.agg(F.sum("n_words").alias("n")).select(F.lit("words").alias("name"), "n")
    return total.select("name", "n", F.lit(computed.first()[0]).alias("n_computed"))


_CH = "c AS (SELECT id, min(page_id) AS page_id, min(chunk_index) AS i FROM document_chunks WHERE page_id IS NOT NULL AND chunk_index IS NOT NULL GROUP BY id), o AS (SELECT page_id, i, min(id) AS id FROM c GROUP BY page_id, i)"


@R.query(f"""WITH {_CH} SELECT 'WROTE' AS rel, member_id AS src, CAST(doc_id AS VARCHAR) AS dst FROM documents WHERE member_id IS NOT NULL UNION ALL SELECT 'PART_OF', id, page_id FROM c
 UNION ALL SELECT 'NEXT', before, id FROM (SELECT id, lag(id) OVER (PARTITION BY page_id ORDER BY i) AS before FROM o) WHERE before IS NOT NULL""")
def structure_layer(spark: SparkSession, d: str) -> DataFrame:
    """The graph that a corpus has by itself: who wrote what, what is part of what, what follows."""
    docs = table(spark, d, "documents").filter("member_id is not null").select(F.lit("WROTE").alias("rel"), F.col("member_id").alias("src"), F.col("doc_id").cast("string").alias("dst"))
    c = table(spark, d, "document_chunks").filter("page_id is not null and chunk_index is not null").groupBy("id").agg(F.min("page_id").alias("page_id"), F.min("chunk_index").alias("i"))
    o = last_before(c.groupBy("page_id", "i").agg(F.min("id").alias("id")), ["page_id"], "i", ["id"]).filter("id_before is not null")
    part = c.select(F.lit("PART_OF").alias("rel"), F.col("id").alias("src"), F.col("page_id").alias("dst"))
    return docs.unionByName(part).unionByName(o.select(F.lit("NEXT").alias("rel"), F.col("id_before").alias("src"), F.col("id").alias("dst")))


@R.query(_E + """SELECT chunk_id, node, count(*) AS n, max(entity_type) AS entity_type FROM (SELECT DISTINCT edge_id, chunk_id, unnest([src, dst]) AS node FROM e JOIN (SELECT DISTINCT id, chunk_id FROM edges) x ON x.id = edge_id) JOIN ents ON entity_id = node JOIN (SELECT DISTINCT id FROM document_chunks) c ON c.id = chunk_id GROUP BY chunk_id, node""")
def semantic_layer(spark: SparkSession, d: str) -> DataFrame:
    """Edges from chunks to the entities their statements name, derived from statements and provenance."""
    e = _edges(spark, d).join(table(spark, d, "edges").select(F.col("id").alias("edge_id"), "chunk_id").distinct(), "edge_id")
    each = e.select("edge_id", "chunk_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = table(spark, d, "entities").groupBy(F.col("entity_id").alias("node")).agg(F.min("entity_type").alias("entity_type"))
    chunks = table(spark, d, "document_chunks").select(F.col("id").alias("chunk_id")).distinct()
    return each.join(known, "node").join(chunks, "chunk_id", "left_semi").groupBy("chunk_id", "node").agg(F.count("*").alias("n"), F.max("entity_type").alias("entity_type"))


@R.query("""WITH r AS (SELECT DISTINCT id, chunk_id FROM kg_evidence WHERE regexp_matches(chunk_id, '\\S')), f AS (SELECT DISTINCT id, split_part(id, '#', 1) AS base FROM document_chunks)
 SELECT state, count(*) AS n FROM (SELECT r.id, CASE WHEN chunk_id IN (SELECT id FROM f) THEN 'exact' WHEN split_part(chunk_id, '#', 1) IN (SELECT base FROM f) THEN 'by page' ELSE 'none' END AS state FROM r) GROUP BY state""")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """References resolved as they stand, else by a part of the path, both by equality."""
    base = lambda c: F.split_part(F.col(c), F.lit("#"), F.lit(1)).alias("base")
    r = table(spark, d, "kg_evidence").filter(F.col("chunk_id").rlike(r"\S")).select("id", "chunk_id", base("chunk_id")).distinct()
    f = table(spark, d, "document_chunks")
    exact, page = f.select(F.col("id").alias("chunk_id"), F.lit(1).alias("e")).distinct(), f.select(base("id"), F.lit(1).alias("p")).distinct()
    state = F.when(F.col("e") == 1, "exact").when(F.col("p") == 1, "by page").otherwise("none")
    return r.join(exact, "chunk_id", "left").join(page, "base", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@R.query("""SELECT predicate, count(*) FILTER (object_literal IS NOT NULL) AS n_literals, count(*) FILTER (object_id IS NOT NULL) AS n_relations, bool_or(object_literal IS NOT NULL) AND bool_or(object_id IS NOT NULL) AS is_dual FROM (SELECT DISTINCT id, predicate, object_id, object_literal FROM kg_edges) GROUP BY predicate""")
def predicate_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Predicates with literals, with relations, and with both."""
    g = table(spark, d, "kg_edges").select("id", "predicate", "object_id", "object_literal").distinct().groupBy("predicate")
    out = g.agg(F.count("object_literal").alias("n_literals"), F.count("object_id").alias("n_relations"))
    return out.withColumn("is_dual", (F.col("n_literals") > 0) & (F.col("n_relations") > 0))


@R.query("""SELECT entity_id, array_to_string(list_sort(list(DISTINCT label)), ' | ') AS labels, count(DISTINCT label) AS n FROM entities WHERE label IS NOT NULL GROUP BY entity_id HAVING count(DISTINCT label) > 1""")
def conflicting_labels(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose sources disagree, with all that they say."""
    g = table(spark, d, "entities").filter("label is not null").groupBy("entity_id").agg(F.array_sort(F.collect_set("label")).alias("l"))
    return g.filter(F.size("l") > 1).select("entity_id", F.array_join("l", " | ").alias("labels"), F.size("l").cast("bigint").alias("n"))


@R.query(f"""WITH f AS (SELECT DISTINCT id, subject, predicate, object, chunk_id, {_FLAT} AS claim FROM edges), k AS (SELECT f.*, object IN (SELECT entity_id FROM entities) AS listed, row_number() OVER (PARTITION BY chunk_id, claim ORDER BY id, subject, object) AS r FROM f WHERE object IS NOT NULL)
 SELECT predicate, count(*) FILTER (subject = object) AS n_self, count(*) FILTER (subject <> object AND r > 1) AS n_repeated, count(*) FILTER (subject <> object AND r = 1 AND NOT listed) AS n_unlisted, count(*) FILTER (subject <> object AND r = 1 AND listed) AS n_kept FROM k GROUP BY predicate""")
def finding_validation(spark: SparkSession, d: str) -> DataFrame:
    """Findings about themselves, said again in a chunk, about unknown names, and kept: the first that holds."""
    f = table(spark, d, "edges").select("id", "subject", "predicate", "object", "chunk_id", X.squeeze(F.col("evidence")).alias("claim")).distinct().filter("object is not null")
    listed = table(spark, d, "entities").select(F.col("entity_id").alias("object"), F.lit(True).alias("listed")).distinct()
    least = f.groupBy("chunk_id", "claim").agg(F.min(F.struct("id", "subject", "object")).alias("one"))
    same = f["chunk_id"].eqNullSafe(least["chunk_id"]) & f["claim"].eqNullSafe(least["claim"])
    j = f.join(least, same).select(f["id"], f["subject"], f["predicate"], f["object"], "one").join(listed, "object", "left")
    first = F.struct("id", "subject", "object") == F.col("one")
    state = F.when(F.col("subject") == F.col("object"), "self").when(~first, "repeated").when(F.col("listed").isNull(), "unlisted").otherwise("kept")
    g = j.withColumn("state", state).groupBy("predicate")
    return g.agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("self", "repeated", "unlisted", "kept")))


@R.query("""WITH e AS (SELECT DISTINCT id, subject, predicate, object, extraction_run AS run FROM edges), fresh AS (SELECT subject, 'HAS_AREA' AS predicate, min(object) AS object FROM e WHERE predicate = 'BELONGS_TO' AND object IS NOT NULL GROUP BY subject)
 SELECT predicate, run, count(*) AS n FROM (SELECT predicate, run FROM e WHERE NOT (run IS NOT DISTINCT FROM 'run-01' AND predicate = 'MENTIONS') UNION ALL SELECT predicate, 'managed' FROM fresh) GROUP BY ALL""")
def overlay_replace(spark: SparkSession, d: str) -> DataFrame:
    """The edges that an overlay manages are replaced as a whole; all others stay."""
    e = table(spark, d, "edges").select("id", "subject", "predicate", "object", F.col("extraction_run").alias("run")).distinct()
    kept = e.filter(~(F.col("run").eqNullSafe("run-01") & (F.col("predicate") == "MENTIONS"))).select("predicate", "run")
    fresh = e.filter("predicate = 'BELONGS_TO' and object is not null").select("subject").distinct().select(F.lit("HAS_AREA").alias("predicate"), F.lit("managed").alias("run"))
    return kept.unionByName(fresh).groupBy("predicate", "run").agg(F.count("*").alias("n"))


@R.query("""WITH w AS (SELECT DISTINCT doc_id FROM documents WHERE source = 'repo'), g AS (SELECT doc_id, count(*) AS n FROM subject_labels WHERE doc_id IS NOT NULL GROUP BY doc_id)
 SELECT 'missing' AS state, count(*) AS n FROM w WHERE doc_id NOT IN (SELECT doc_id FROM g) UNION ALL SELECT 'unexpected', count(*) FROM g WHERE doc_id NOT IN (SELECT doc_id FROM w) UNION ALL SELECT 'repeated', count(*) FROM g WHERE n > 1""")
def reviewed_set(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was reviewed is exactly what was to be: missing, unexpected and repeated ids."""
    w = table(spark, d, "documents").filter("source = 'repo'").select("doc_id").distinct()
    g = table(spark, d, "subject_labels").filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k"))
    part = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "n")
    return part(w.join(g, "doc_id", "left_anti"), "missing").unionByName(part(g.join(w, "doc_id", "left_anti"), "unexpected")).unionByName(part(g.filter("k > 1"), "repeated"))


@R.query("""SELECT id, CASE WHEN n = 0 THEN 'absent' WHEN n = 1 THEN 'grounded' ELSE 'ambiguous' END AS state FROM (SELECT e.id, max((length(c.content) - length(replace(c.content, e.evidence, ''))) // length(e.evidence)) AS n
 FROM (SELECT DISTINCT id, chunk_id, evidence FROM edges WHERE length(evidence) > 0) e JOIN document_chunks c ON c.id = e.chunk_id WHERE c.content IS NOT NULL GROUP BY e.id)""")
def grounded_facts(spark: SparkSession, d: str) -> DataFrame:
    """A fact is grounded if its evidence stands in its chunk once; twice is ambiguous."""
    e = table(spark, d, "edges").filter(F.length("evidence") > 0).select("id", "chunk_id", "evidence").distinct()
    c = table(spark, d, "document_chunks").filter("content is not null").select(F.col("id").alias("chunk_id"), "content")
    times = F.floor((F.length("content") - F.length(F.replace("content", "evidence", F.lit("")))) / F.length("evidence"))
    n = e.join(c, "chunk_id").groupBy("id").agg(F.max(times).alias("n"))
    return n.select("id", F.when(F.col("n") == 0, "absent").when(F.col("n") == 1, "grounded").otherwise("ambiguous").alias("state"))


@R.query("""SELECT m.name AS name, min(e.entity_id) AS entity_id, count(DISTINCT e.entity_id) AS n FROM (SELECT DISTINCT lower(name) AS name FROM kg_entities WHERE entity_type = 'person') m JOIN (SELECT DISTINCT entity_id, lower(label) AS name FROM entities WHERE entity_type = 'person') e USING (name) GROUP BY m.name""")
def identity_links(spark: SparkSession, d: str) -> DataFrame:
    """Identities of one store approved for the people of another by the same name; several are told."""
    m = table(spark, d, "kg_entities").filter("entity_type = 'person'").select(F.lower("name").alias("name")).distinct()
    e = table(spark, d, "entities").filter("entity_type = 'person'").select("entity_id", F.lower("label").alias("name")).distinct()
    return m.join(e, "name").groupBy("name").agg(F.min("entity_id").alias("entity_id"), F.count_distinct("entity_id").alias("n"))


@R.query("""WITH c AS (SELECT id, min(id) OVER (PARTITION BY sha256(trim(regexp_replace(content, '[\\s\\x{00A0}]+', ' ', 'g'), ' '))) AS canonical FROM document_chunks WHERE content IS NOT NULL), a AS (SELECT id, min(canonical) AS canonical FROM c GROUP BY id), t AS (SELECT id, min(source) AS source FROM document_chunks GROUP BY id)
 SELECT r.chunk_id, a.canonical, CASE WHEN a.canonical IS NULL THEN 'unknown' ELSE 'known' END AS state, t.source FROM (SELECT DISTINCT chunk_id FROM edges WHERE chunk_id IS NOT NULL) r LEFT JOIN a ON a.id = r.chunk_id LEFT JOIN t ON t.id = a.canonical""")
def canonical_results(spark: SparkSession, d: str) -> DataFrame:
    """Result ids through a map of copies, their attributes from the corpus; unknown ids are told."""
    chunks = table(spark, d, "document_chunks")
    a = K.canonical_rows(chunks, "id", "content").groupBy(F.col("key").alias("chunk_id")).agg(F.min("canonical").alias("canonical"))
    t = chunks.groupBy(F.col("id").alias("canonical")).agg(F.min("source").alias("source"))
    r = table(spark, d, "edges").filter("chunk_id is not null").select("chunk_id").distinct()
    state = F.when(F.col("canonical").isNull(), "unknown").otherwise("known")
    return r.join(a, "chunk_id", "left").join(t, "canonical", "left").select("chunk_id", "canonical", state.alias("state"), "source")


@R.query("""SELECT id, regexp_extract(page_id, '([0-9a-f]{8,})$', 1) AS page_key, split_part(page_id, '-', 1) AS topic, CASE WHEN source IN ('wiki', 'vault') THEN 'note' WHEN source = 'repo' THEN 'code' ELSE 'page' END AS kind, regexp_replace(coalesce(title, ''), ' ?[0-9]+$', '') AS bare_title FROM (SELECT DISTINCT id, page_id, source, title FROM document_chunks)""")
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    """What a path says: topic, kind, key of the page, title without its number."""
    c = table(spark, d, "document_chunks").select("id", "page_id", "source", "title").distinct()
    kind = F.when(F.col("source").isin("wiki", "vault"), "note").when(F.col("source") == "repo", "code").otherwise("page")
    return c.select("id", F.regexp_extract("page_id", "([0-9a-f]{8,})$", 1).alias("page_key"), F.split_part("page_id", F.lit("-"), F.lit(1)).alias("topic"), kind.alias("kind"), F.regexp_replace(F.coalesce("title", F.lit("")), " ?[0-9]+$", "").alias("bare_title"))


@R.query("""SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'), ' ') AS body, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '#([0-9A-Za-z_가-힣]+)', 1))), ',') AS tags, n_chars >= 0 AND n_chars IS NOT NULL AS counted FROM documents WHERE source = 'social' AND text IS NOT NULL""")
def normalised_posts(spark: SparkSession, d: str) -> DataFrame:
    """Collected posts with trimmed bodies, their tags, and whether their metric can be used."""
    p = table(spark, d, "documents").filter("source = 'social' and text is not null")
    return p.select("doc_id", X.squeeze(F.col("text")).alias("body"), F.array_join(F.array_sort(X.hashtags(F.col("text"))), ",").alias("tags"), F.coalesce(F.col("n_chars") >= 0, F.lit(False)).alias("counted"))


@R.query("""WITH m AS (SELECT room_id, lower(name) AS name FROM members WHERE NOT contains(name, ' ') GROUP BY ALL), w AS (SELECT id, room_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM messages WHERE text IS NOT NULL)
 SELECT id, string_agg(CASE WHEN m.name IS NULL THEN w.w ELSE '[name]' END, ' ' ORDER BY i) AS text FROM w LEFT JOIN m ON m.room_id = w.room_id AND m.name = lower(w.w) GROUP BY id HAVING count(m.name) > 0""")
def replaced_names(spark: SparkSession, d: str) -> DataFrame:
    """Words of messages that are names of the room's members replaced; words are looked up by equality."""
    m = table(spark, d, "members").filter(~F.contains("name", F.lit(" "))).select("room_id", F.lower("name").alias("name")).distinct()
    t = table(spark, d, "messages").filter("text is not null").select("id", "room_id", "text")
    asked = t.select("id", "room_id", F.explode(F.array_distinct(F.transform(F.split("text", " "), lambda w: F.lower(w)))).alias("name"))
    found = asked.join(m, ["room_id", "name"]).groupBy("id").agg(F.collect_set("name").alias("names"))
    put = F.transform(F.split("text", " "), lambda w: F.when(F.array_contains("names", F.lower(w)), "[name]").otherwise(w))
    return t.join(found, "id").select("id", F.array_join(put, " ").alias("text"))


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@R.query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(title)), '[^0-9a-z가-힣 -]', '', 'g'), ' +', ' ', 'g'), ' ') AS key FROM documents WHERE title IS NOT NULL""")
def unicode_keys(spark: SparkSession, d: str) -> DataFrame:
    """One composition, lower case, letters, digits, spaces and hyphens only; Python sees only what isn't plain."""
    t = F.col("title")
    plain = t.rlike(r"^[\x00-\x7F가-힣]*$")
    whole = F.when(plain, t).otherwise(F.pandas_udf(_composed, "string")(F.when(~plain, t)))
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(whole), "[^0-9a-z가-힣 -]", ""), " +", " "))
    return table(spark, d, "documents").filter("title is not null").select("doc_id", key.alias("key"))


@R.query("""SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN regexp_matches(l, '\\[[^\\]]+\\]\\([^)]+\\)') THEN 'link' WHEN regexp_matches(l, 'https?://') THEN 'address' ELSE 'title' END AS kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(l, '^\\s*[-*] ')) GROUP BY ALL""")
def reading_lines(spark: SparkSession, d: str) -> DataFrame:
    """The items of lists by what they are: link, address or title."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(F.col("l").rlike(r"^\s*[-*] "))
    kind = F.when(F.col("l").rlike(r"\[[^\]]+\]\([^)]+\)"), "link").when(F.col("l").rlike("https?://"), "address").otherwise("title")
    return lines.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@R.query("""SELECT id, lower(regexp_extract(content, '(?i)(?:^|\\n|[{, ])"?(status|type|kind)"? *: *"?([A-Za-z]+)', 1)) AS field, lower(regexp_extract(content, '(?i)(?:^|\\n|[{, ])"?(status|type|kind)"? *: *"?([A-Za-z]+)', 2)) AS value FROM (SELECT DISTINCT id, content FROM document_chunks) WHERE lower(regexp_extract(content, '(?i)(?:^|\\n|[{, ])"?(status|type|kind)"? *: *"?([A-Za-z]+)', 2)) IN ('open', 'done', 'draft', 'closed', 'note', 'plan', 'review')""")
def status_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields whose values are of a closed vocabulary; others are dropped."""
    pattern = r'(?i)(?:^|\n|[{, ])"?(status|type|kind)"? *: *"?([A-Za-z]+)'
    part = lambda n: F.lower(F.regexp_extract("content", pattern, n))
    rows = table(spark, d, "document_chunks").select("id", "content").distinct().select("id", part(1).alias("field"), part(2).alias("value"))
    return rows.filter(F.col("value").isin("open", "done", "draft", "closed", "note", "plan", "review"))


_COMMIT = """WITH f AS (SELECT page_id AS sha, CASE WHEN source = 'repo' THEN 'members/' || page_id || '/labs/' || id || '.py' WHEN source = 'vault' THEN 'notes/' || id || '.md' WHEN source = 'chat' THEN '.github/' || id ELSE 'docs/' || id END AS path FROM document_chunks WHERE page_id IS NOT NULL GROUP BY ALL), w AS (SELECT * FROM f WHERE NOT regexp_matches(path, '(^|/)(\\.git[^/]*|\\.github/.*|package-lock\\.json|poetry\\.lock|uv\\.lock|\\.DS_Store)$'))"""


def _commits(spark: SparkSession, d: str) -> DataFrame:
    """Pages as commits and their chunks as the files, in place of a history; sources/gitlog.py reads real ones."""
    path = (
        F.when(F.col("source") == "repo", F.concat(F.lit("members/"), "page_id", F.lit("/labs/"), "id", F.lit(".py"))).when(F.col("source") == "vault", F.concat(F.lit("notes/"), "id", F.lit(".md")))
        .when(F.col("source") == "chat", F.concat(F.lit(".github/"), "id")).otherwise(F.concat(F.lit("docs/"), "id"))
    )
    f = table(spark, d, "document_chunks").filter("page_id is not null").select(F.col("page_id").alias("sha"), path.alias("path")).distinct()
    return f.filter(~F.col("path").rlike(commits.HOUSEKEEPING))


@R.query(_COMMIT + """ SELECT sha, count(*) AS n_files, CASE WHEN bool_or(regexp_matches(path, '(^|/)labs?/')) THEN 'lab' WHEN bool_or(regexp_matches(path, '(^|/)notes?/|\\.md$')) THEN 'note' WHEN bool_or(regexp_matches(path, '(^|/)readings?/')) THEN 'reading' WHEN bool_or(regexp_matches(path, '(^|/)(shared|docs)/')) THEN 'shared' ELSE 'commit' END AS kind FROM w GROUP BY sha""")
def commit_groups(spark: SparkSession, d: str) -> DataFrame:
    """Commits without housekeeping by the first kind that a path tells; kinds are summed up, no
    list of paths is gathered."""
    kind = F.lit("commit")
    for name, pattern in reversed(commits.KINDS):
        kind = F.when(F.bool_or(F.col("path").rlike(pattern)), name).otherwise(kind)
    return _commits(spark, d).groupBy("sha").agg(F.count("*").alias("n_files"), kind.alias("kind"))


@R.query(_COMMIT + """ SELECT i.item, count(*) AS n FROM w JOIN (SELECT DISTINCT 'members/' || page_id AS item FROM document_chunks WHERE source = 'repo' AND page_id IS NOT NULL) i ON starts_with(w.path, i.item || '/') GROUP BY i.item""")
def path_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Files by the item whose folder they lie in: every folder of a path is looked up by equality."""
    items = table(spark, d, "document_chunks").filter("source = 'repo' and page_id is not null").select(F.concat(F.lit("members/"), "page_id").alias("item")).distinct()
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    each = _commits(spark, d).filter(F.contains("path", F.lit("/"))).select("path", F.explode(folders).alias("item"))
    return each.join(items, "item").groupBy("item").agg(F.count("*").alias("n"))


@R.query("""SELECT id, regexp_replace(text, '(김|이|박|최|정)([가-힣]{2}) (님|씨)', '\\1○○ \\3', 'g') AS text FROM messages WHERE text IS NOT NULL AND regexp_matches(text, '(김|이|박|최|정)([가-힣]{2}) (님|씨)')""")
def demo_masking(spark: SparkSession, d: str) -> DataFrame:
    """The given name before a word of respect, for showing."""
    pattern = "(김|이|박|최|정)([가-힣]{2}) (님|씨)"
    return table(spark, d, "messages").filter(F.col("text").rlike(pattern)).select("id", F.regexp_replace("text", pattern, "$1○○ $3").alias("text"))


@R.query("""SELECT id, (h % 12 + CASE WHEN half = '오후' THEN 12 ELSE 0 END) * 60 + mi AS minute FROM (SELECT id, (CASE WHEN hour(sent_at) >= 12 THEN '오후' ELSE '오전' END) AS half, CAST((hour(sent_at) + 11) % 12 + 1 AS INT) AS h, CAST(minute(sent_at) AS INT) AS mi FROM messages WHERE sent_at IS NOT NULL)""")
def twelve_hour_clock(spark: SparkSession, d: str) -> DataFrame:
    """Times written by the twelve-hour clock, read again."""
    h = F.hour("sent_at")
    said = F.concat(F.when(h >= 12, "오후 ").otherwise("오전 "), ((h + 11) % 12 + 1).cast("string"), F.lit(":"), F.lpad(F.minute("sent_at").cast("string"), 2, "0"))
    return table(spark, d, "messages").filter("sent_at is not null").select("id", X.clock_12h(said).alias("minute"))


@R.query("""SELECT id, name FROM (SELECT id, arg_max(name, loaded_at) AS name FROM kg_entities GROUP BY id)""")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    """Rows in two batches into a keyed table, the later replacing the earlier."""
    rows = cut(K.latest_of(table(spark, d, "kg_entities").select("id", "name", "loaded_at"), ["id"], ["loaded_at"]), "upsert-rows")
    path = _place(spark, "upsert")
    write = upsert_batches(path, ["id"])
    write(rows.withColumn("name", F.lit("old")).select("id", "name"), 0)
    write(rows.select("id", "name"), 1)
    return spark.read.parquet(f"{path}/version=000000001").select("id", "name")


@R.query("SELECT id, text FROM messages WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\t\\n\\r\"\\\\]') AND trim(text) = text AND text <> ''")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Messages through tab-separated values."""
    path = _place(spark, "tsv")
    rows = table(spark, d, "messages").select("id", "text").filter("text is not null and text <> ''").filter(~F.col("text").rlike(r'[\t\n\r"\\]') & (F.trim("text") == F.col("text")))
    files.write_tsv(rows, path)
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").schema("id bigint, text string").csv(path)


@R.query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source")
def json_document_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whole JSON documents of at most a thousand rows each, a file each, and their inner arrays."""
    path = _place(spark, "json")
    docs = table(spark, d, "documents").filter("source is not null and text is not null").select("source", "doc_id", F.floor(F.col("doc_id") / 1000).alias("part"))
    docs.groupBy("source", "part").agg(F.collect_list(F.struct("doc_id", "source")).alias("items")).select("items").write.option("maxRecordsPerFile", 1).json(path)
    return files.read_json_document(spark, path, "items array<struct<doc_id:bigint,source:string>>", "items").groupBy("source").agg(F.count("*").alias("n"))
