"""Queries of lexical and vector retrieval, fusion and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernlake.functions.text import character_ngrams, words
from quernlake.operators import dense, lexical, metrics
from quernlake.operators import ranking as rank
from quernlake.plans.registry import Registry
from quernlake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: The questions of the search queries.
QUESTIONS = (("q1", "rollback plan release branch"), ("q2", "벡터인덱스 파티션키 재현율"), ("q3", "learning rate loss curve learning rate"), ("q4", "contract"))
_TOK = "regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+')"
_QSQL = ", ".join(f"('{q}', '{t}')" for q, t in QUESTIONS)


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id string, text string")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "title")


def _bm25_sql(k1: float, b: float, times: str = "1", having: str = "") -> str:
    return f"""
WITH q AS (SELECT query_id, unnest(regexp_extract_all(lower(t), '[0-9A-Za-z가-힣]+')) AS term FROM (VALUES {_QSQL}) v(query_id, t)),
qt AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
tok AS (SELECT doc_id, {_TOK} AS t FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
hit AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
parts AS (SELECT query_id, doc_id, term, times, tf, dl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)) AS tf_part
  FROM hit JOIN dfs USING (term) JOIN qt USING (term), st),
bm AS (SELECT query_id, doc_id, round(sum(idf * tf_part * {times}), 6) AS score FROM parts GROUP BY query_id, doc_id {having}),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)
"""


def _bm25(spark: SparkSession, d: str, k: int = 10, **options) -> DataFrame:
    scored = lexical.bm25(_docs(spark, d), _questions(spark), **options)
    return rank.top_k(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], k, "doc_id").select("query_id", "doc_id", "score", "rank")


@R.query(_bm25_sql(1.2, 0.75).replace(f"(VALUES {_QSQL}) v(query_id, t)", "(SELECT doc_id AS query_id, title AS t FROM documents WHERE doc_id % 50 = 0) v") + "SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 10")
def bm25_titles(spark: SparkSession, d: str) -> DataFrame:
    """Every title whose document's id is divisible by 50 is a query."""
    titles = _docs(spark, d).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    return lexical.bm25_top(_docs(spark, d), titles, 10)


@R.query(_bm25_sql(1.2, 0.75) + "SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 10")
def bm25_matching_only(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of matching documents."""
    return _bm25(spark, d)


@R.query(_bm25_sql(1.5, 0.75, "times") + "SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 10")
def bm25_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """BM25 that counts repeated query terms."""
    return _bm25(spark, d, k1=1.5, multiplicity=True)


@R.query(_bm25_sql(1.2, 0.75) + "SELECT query_id, source, count(*) AS n, round(sum(score), 4) AS total FROM (SELECT q.query_id, d.doc_id, d.source, coalesce(b.score, 0) AS score FROM (SELECT DISTINCT query_id FROM qt) q CROSS JOIN documents d LEFT JOIN bm b ON b.query_id = q.query_id AND b.doc_id = d.doc_id WHERE d.text IS NOT NULL) GROUP BY ALL")
def bm25_all_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents take part, those without a hit with zero; the zeros are counted, not made."""
    docs = _docs(spark, d).filter("text is not null")
    scored = lexical.bm25(docs, _questions(spark)).join(docs.select("doc_id", "source"), "doc_id")
    hits = scored.groupBy("query_id", "source").agg(F.sum("score").alias("total"))
    sizes = docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("query_id", F.explode(F.array(*(F.lit(q) for q, _ in QUESTIONS))))
    joined = sizes.join(hits, (sizes["query_id"] == hits["query_id"]) & sizes["source"].eqNullSafe(hits["source"]), "left")
    return joined.select(sizes["query_id"], sizes["source"], "n", F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total"))


@R.query(_bm25_sql(1.2, 0.75, "1", "HAVING count(*) = (SELECT count(*) FROM qt WHERE qt.query_id = parts.query_id)") + "SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 10")
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    """Only documents with all terms."""
    return _bm25(spark, d, require_all=True)


@R.query(_bm25_sql(1.2, 0.75) + "SELECT query_id, doc_id, term, round(idf, 6) AS idf, round(tf_part, 6) AS tf_part, tf, CAST(dl AS BIGINT) AS dl FROM parts")
def bm25_explain(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the scores."""
    return lexical.bm25(_docs(spark, d), _questions(spark), parts=True).withColumn("dl", F.col("dl").cast("bigint"))


def _field_sql(field: str) -> str:
    return _bm25_sql(1.2, 0.75).replace("lower(text)", f"lower({field})").replace("text IS NOT NULL", f"{field} IS NOT NULL").replace("WITH q AS", "WITH q AS", 1)


@R.query(f"""SELECT query_id, doc_id, greatest(coalesce(2 * s_title, 0), coalesce(s_text, 0)) AS score FROM
 ({_field_sql('title')} SELECT query_id, doc_id, score AS s_title FROM bm) FULL JOIN ({_field_sql('text')} SELECT query_id, doc_id, score AS s_text FROM bm) USING (query_id, doc_id)""")
def bm25_two_field(spark: SparkSession, d: str) -> DataFrame:
    """The better of twice the title's and the text's score."""
    docs = _docs(spark, d)
    title = lexical.bm25(docs.select("doc_id", F.col("title").alias("text")), _questions(spark)).withColumnRenamed("score", "s_title")
    text = lexical.bm25(docs, _questions(spark)).withColumnRenamed("score", "s_text")
    best = F.greatest(F.coalesce(F.col("s_title") * 2, F.lit(0.0)), F.coalesce("s_text", F.lit(0.0)))
    return title.join(text, ["query_id", "doc_id"], "outer").select("query_id", "doc_id", best.alias("score"))


@R.query(_bm25_sql(1.2, 0.75) + """SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm JOIN documents USING (doc_id)
 WHERE source = 'wiki' QUALIFY rank <= 10""")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A filter that leaves the statistics alone."""
    docs = _docs(spark, d)
    scored = lexical.bm25(docs, _questions(spark)).join(docs.filter("source = 'wiki'").select("doc_id"), "doc_id", "left_semi")
    return rank.top_k(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], 10, "doc_id").select("query_id", "doc_id", "score", "rank")


@R.query("""SELECT doc_id, CAST((length(p) - length(replace(p, ' release  branch ', ''))) / 17 AS BIGINT) AS n FROM (SELECT doc_id, ' ' || replace(array_to_string(""" + _TOK + """, ' '), ' ', '  ') || ' ' AS p FROM documents WHERE text IS NOT NULL)
 WHERE contains(p, ' release  branch ')""")
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the phrase."""
    return lexical.phrase_matches(_docs(spark, d), "release branch")


@R.query(f"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOK})) AS BIGINT) AS n_distinct FROM documents WHERE text IS NOT NULL")
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    """L1: words of documents."""
    t = words(F.col("text"))
    return _docs(spark, d).filter("text is not null").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@R.query("""SELECT gram, count(*) AS n FROM (SELECT unnest([substr(b, i, 2) FOR i IN range(1, length(b))]) AS gram FROM (SELECT regexp_replace(lower(title), '[^0-9a-z가-힣]', '', 'g') AS b FROM documents)) GROUP BY gram""")
def ngram_tokens(spark: SparkSession, d: str) -> DataFrame:
    """L2: pairs of characters of titles."""
    return _docs(spark, d).select(F.explode(character_ngrams(F.col("title"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@R.query(f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, round(ln(1 + (n - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)), 6) AS idf
 FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents WHERE text IS NOT NULL), (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL) GROUP BY term, n""")
def df_idf(spark: SparkSession, d: str) -> DataFrame:
    """Document and corpus frequencies."""
    docs = _docs(spark, d).filter("text is not null")
    n = float(docs.count())
    return lexical.postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("idf", F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6))


@R.query("""SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE contains(lower(text), 'memory leak') GROUP BY source""")
def grep_count(spark: SparkSession, d: str) -> DataFrame:
    """Substring search, case-insensitive."""
    return _docs(spark, d).filter(F.lower("text").contains("memory leak")).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@R.query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'memory leak') ORDER BY published_at, doc_id LIMIT 20")
def grep_top(spark: SparkSession, d: str) -> DataFrame:
    """The first hits by time."""
    return table(spark, d, "documents").filter(F.lower("text").contains("memory leak")).orderBy(F.asc_nulls_last("published_at"), "doc_id").limit(20).select("doc_id", "source")


@R.query("""SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)rollback|롤백|복구 [0-9]+') GROUP BY source""")
def grep_regex(spark: SparkSession, d: str) -> DataFrame:
    """Regular expression search."""
    return _docs(spark, d).filter(F.col("text").rlike("(?i)rollback|롤백|복구 [0-9]+")).groupBy("source").agg(F.count("*").alias("n"))


@R.query("""SELECT room_id, count(*) AS n FROM chunks WHERE end_at >= TIMESTAMP '2015-01-08' AND start_at < TIMESTAMP '2015-01-12' GROUP BY room_id""")
def date_range_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that overlap a half-open interval; pushed down to the scan."""
    when = (F.col("end_at") >= F.lit("2015-01-08").cast("timestamp_ntz")) & (F.col("start_at") < F.lit("2015-01-12").cast("timestamp_ntz"))
    return table(spark, d, "chunks").filter(when).groupBy("room_id").agg(F.count("*").alias("n"))


@R.query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= (SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 1 MONTH FROM orders) AND o_orderdate < (SELECT date_trunc('month', max(o_orderdate)) FROM orders) GROUP BY o_orderpriority""")
def prev_month(spark: SparkSession, d: str) -> DataFrame:
    """The calendar month before the last."""
    orders = table(spark, d, "orders")
    last = orders.agg(F.date_trunc("month", F.max("o_orderdate")).cast("timestamp_ntz").alias("m")).first().m
    end = F.lit(last).cast("timestamp_ntz")
    return orders.filter((F.col("o_orderdate") >= end - F.expr("interval 1 month")) & (F.col("o_orderdate") < end)).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@R.query("""WITH names AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(description), '[a-z]+'), ' ') AS all_words, area FROM subject_areas),
 dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(description), '[a-z]+')) AS name, area AS entity FROM subject_areas)
 SELECT doc_id, entity, count(*) AS n FROM (SELECT doc_id, unnest(""" + _TOK + """) AS name FROM documents WHERE text IS NOT NULL) JOIN dict USING (name) GROUP BY ALL""")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Words of a dictionary in texts, by an equality join."""
    areas = table(spark, d, "subject_areas").select(F.explode(F.regexp_extract_all(F.lower("description"), F.lit("[a-z]+"), F.lit(0))).alias("name"), F.col("area").alias("entity"))
    return lexical.dictionary_mentions(_docs(spark, d), areas, longest=1)


_DEDUP = "lower(regexp_replace(text, '[\\s\\x{00A0}]+', '', 'g'))"


@R.query(_bm25_sql(1.2, 0.75) + f"""SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT query_id, doc_id, rank FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 30
 QUALIFY row_number() OVER (PARTITION BY query_id, {_DEDUP} ORDER BY rank) = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10""")
def dedup_top30(spark: SparkSession, d: str) -> DataFrame:
    """Among the first 30 each content once, then the first ten."""
    docs = _docs(spark, d).select("doc_id", F.sha2(F.lower(F.regexp_replace("text", r"[\s\x{00A0}]+", "")), 256).alias("content"))
    top = _bm25(spark, d, 30).join(docs, "doc_id")
    once = top.withColumn("r", F.row_number().over(W.partitionBy("query_id", "content").orderBy("rank"))).filter("r = 1")
    again = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    return again.filter("rank <= 10").select("query_id", "doc_id", "rank")


# Fusion: the BM25 arm, and documents that hold the question's first word ranked by their age.
_ARMS = _bm25_sql(1.2, 0.75) + f""", grep AS (SELECT query_id, doc_id, 1.0 / rank AS score, rank FROM (SELECT v.query_id, doc_id, row_number() OVER (PARTITION BY v.query_id ORDER BY published_at NULLS LAST, doc_id) AS rank
  FROM documents JOIN (VALUES {_QSQL}) v(query_id, t) ON contains(lower(text), split_part(v.t, ' ', 1))) WHERE rank <= 50),
 lists AS (SELECT query_id, 'bm25' AS method, doc_id, score, rank FROM bm25 WHERE rank <= 50 UNION ALL SELECT query_id, 'grep', doc_id, score, rank FROM grep)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    lexical_arm = _bm25(spark, d, 50).withColumn("method", F.lit("bm25"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"), "published_at")
    hits = None
    for q, text in QUESTIONS:
        one = docs.filter(F.col("text").contains(text.split()[0])).select(F.lit(q).alias("query_id"), "doc_id", "published_at")
        hits = one if hits is None else hits.unionByName(one)
    grep = rank.top_k(hits, ["query_id"], [F.asc_nulls_last("published_at"), F.col("doc_id")], 50, "doc_id")
    grep = grep.select("query_id", F.lit("grep").alias("method"), "doc_id", (1.0 / F.col("rank")).alias("score"), "rank")
    return lexical_arm.select("query_id", "method", "doc_id", "score", "rank").unionByName(grep)


@R.query(_ARMS + """SELECT query_id, doc_id, score, n_methods, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
 (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS n_methods, min(rank) AS best_rank FROM lists GROUP BY ALL)""")
def rrf_basic(spark: SparkSession, d: str) -> DataFrame:
    """reciprocal rank fusion."""
    return rank.reciprocal_rank_fusion(_lists(spark, d))


@R.query(_ARMS + """SELECT query_id, doc_id, score, n_methods, best_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id) AS rank FROM
 (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS n_methods, min(rank) AS best_rank FROM lists GROUP BY ALL)""")
def rrf_min_rank_tie(spark: SparkSession, d: str) -> DataFrame:
    """ties by the best rank."""
    return rank.reciprocal_rank_fusion(_lists(spark, d), tie="min_rank")


@R.query(_ARMS + """SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(s * CASE method WHEN 'bm25' THEN 0.7 ELSE 0.3 END), 9) AS score FROM
 (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM lists WINDOW w AS (PARTITION BY query_id, method)) GROUP BY ALL)""")
def minmax_fusion(spark: SparkSession, d: str) -> DataFrame:
    """F2: weighted fusion of scaled scores."""
    return rank.min_max_fusion(_lists(spark, d), {"bm25": 0.7, "grep": 0.3})


@R.query(_ARMS + "SELECT query_id, doc_id, min(rank) FILTER (method = 'bm25') AS rank_bm25, min(rank) FILTER (method = 'grep') AS rank_grep FROM lists GROUP BY ALL")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """the pool with each method's rank."""
    return rank.candidate_pool(_lists(spark, d), ["bm25", "grep"])


@R.query(_ARMS + """SELECT query_id, method, group_id, best_rank, row_number() OVER (PARTITION BY query_id, method ORDER BY best_rank, group_id) AS rank FROM
 (SELECT query_id, method, member_id AS group_id, min(rank) AS best_rank FROM lists JOIN documents USING (doc_id) GROUP BY ALL)""")
def doc_collapse(spark: SparkSession, d: str) -> DataFrame:
    """F8: documents collapsed to their authors."""
    lists = _lists(spark, d).join(table(spark, d, "documents").select("doc_id", "member_id"), "doc_id")
    return rank.collapse(lists, F.col("member_id"))


@R.query(_ARMS + """, seeds AS (SELECT query_id, doc_id, 0 AS stage, rank FROM lists WHERE method = 'bm25' AND rank <= 5), more AS (SELECT query_id, doc_id, 1 AS stage, rank FROM lists WHERE method = 'grep')
 SELECT query_id, doc_id, s.stage AS stage, row_number() OVER (PARTITION BY query_id ORDER BY s.stage, s.rank, doc_id) AS rank FROM (SELECT query_id, doc_id, min({'stage': stage, 'rank': rank}) AS s FROM (FROM seeds UNION ALL FROM more) GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.stage, s.rank, doc_id) <= 12""")
def graph_append(spark: SparkSession, d: str) -> DataFrame:
    """seeds first, then what else there is."""
    lists = _lists(spark, d)
    return rank.append_ranked(lists.filter("method = 'bm25' and rank <= 5"), lists.filter("method = 'grep'"), 12)


@R.query(_ARMS + """SELECT query_id, doc_id, rank, kept, CASE WHEN kept = len THEN 'whole' WHEN kept > 0 THEN 'cut' ELSE 'out' END AS state FROM (SELECT query_id, doc_id, rank, len,
 greatest(0, least(len, 3000 - coalesce(CAST(sum(len) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))) AS kept
 FROM (SELECT query_id, doc_id, rank, CAST(length(text) AS BIGINT) AS len FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 20))""")
def context_pack_truncate(spark: SparkSession, d: str) -> DataFrame:
    """context of a fixed size, cut where it is full."""
    items = _bm25(spark, d, 20).join(table(spark, d, "documents").select("doc_id", F.length("text").alias("length")), "doc_id")
    return rank.pack_truncated(items, 3000).select("query_id", "doc_id", "rank", "kept", "state")


@R.query(_ARMS.replace("WITH", "WITH RECURSIVE", 1) + """, items AS (SELECT query_id, rank, doc_id, CAST(length(text) AS BIGINT) AS len FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 20),
 pack AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS ids FROM items UNION ALL SELECT p.query_id, i.rank, CASE WHEN used + len <= 3000 THEN used + len ELSE used END, CASE WHEN used + len <= 3000 THEN list_append(ids, i.doc_id) ELSE ids END FROM pack p JOIN items i ON i.query_id = p.query_id AND i.rank = p.rank + 1)
 SELECT query_id, CAST(unnest(range(0, len(ids))) AS BIGINT) AS position, unnest(ids) AS doc_id, used FROM pack QUALIFY rank = max(rank) OVER (PARTITION BY query_id)""")
def context_pack_skip(spark: SparkSession, d: str) -> DataFrame:
    """context of a fixed size, passing over what doesn't fit."""
    items = _bm25(spark, d, 20).join(table(spark, d, "documents").select("doc_id", F.length("text").alias("length")), "doc_id")
    return rank.pack_skipping(items, 3000)


# Vectors: every vector whose id is divisible by 50 is a query.
_KNN = """WITH knn AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score, q.label AS q_label, d.label AS label
 FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM knn) """


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    data = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return data.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), data


@R.query(_KNN + "SELECT query_id, id, score, rank FROM ranked WHERE rank <= 10")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    """V1: exact nearest neighbours by cosine."""
    q, data = _vectors(spark, d)
    return dense.nearest(q, data, 10)


@R.query(_KNN + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM knn WHERE label < 5 QUALIFY rank <= 10")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """V6: neighbours among filtered rows only."""
    q, data = _vectors(spark, d)
    return dense.nearest(q, data.filter("label < 5"), 10)


@R.query("""SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) DESC, d.vec_id) AS rank FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id) WHERE rank <= 10""")
def dot_topk(spark: SparkSession, d: str) -> DataFrame:
    """V3: neighbours by dot product."""
    q, data = _vectors(spark, d)
    return dense.nearest(q, data, 10, metric="dot")


@R.query("""SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])), 6) AS norm, abs(sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) - 1) < 0.001 AS is_unit FROM embeddings""")
def l2_norm_check(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of vectors."""
    n = dense.norm(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(n, 6).alias("norm"), (F.abs(n - 1) < 0.001).alias("is_unit"))


@R.query("""SELECT source, fault, count(*) AS n FROM (SELECT source, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not_finite'
 WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'none' END AS fault FROM document_chunks) GROUP BY ALL""")
def vector_valid(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with vectors."""
    fault = F.coalesce(dense.vector_faults(F.col("embedding"), 64), F.lit("none"))
    return table(spark, d, "document_chunks").groupBy("source", fault.alias("fault")).agg(F.count("*").alias("n"))


@R.query("""SELECT id FROM chunks WHERE NOT EXISTS (SELECT 1 FROM chunk_embeddings e WHERE e.chunk_id = chunks.id AND e.model = 'mini-embed-a')""")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """V9: chunks a model hasn't embedded yet."""
    have = table(spark, d, "chunk_embeddings").filter("model = 'mini-embed-a'").select(F.col("chunk_id").alias("id"))
    return table(spark, d, "chunks").select("id").join(have, "id", "left_anti")


def _labelled(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The ranking with whether labels agree, and the queries with how many others have their label: who
    they are isn't listed, as that is every pair of a label."""
    q, data = _vectors(spark, d)
    labels = data.select(F.col("id").alias("doc_id"), F.col("label").alias("doc_label"))
    sizes = data.groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    queries = data.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "label").join(sizes, "label")
    ranking = dense.nearest(q, data, k).select("query_id", F.col("id").alias("doc_id"), "rank").join(labels, "doc_id").join(queries.select("query_id", "label"), "query_id")
    return ranking.withColumn("relevant", F.col("label") == F.col("doc_label")), queries


@R.query(_KNN + """SELECT query_id, CASE WHEN n_gold = 0 THEN NULL ELSE round(n_hit / n_gold, 6) END AS recall, round(n_hit / 10, 6) AS precision, n_hit > 0 AS hit, coalesce(round(1.0 / first_rank, 6), 0) AS reciprocal_rank,
 CASE WHEN n_gold = 0 THEN NULL ELSE round(coalesce(dcg, 0) / idcg, 6) END AS ndcg, first_rank FROM
 (SELECT query_id, count(*) FILTER (rank <= 10 AND label = q_label) AS n_hit, count(*) FILTER (label = q_label) AS n_gold, min(rank) FILTER (rank <= 10 AND label = q_label) AS first_rank,
  sum(1 / log2(rank + 1)) FILTER (rank <= 10 AND label = q_label) AS dcg FROM ranked GROUP BY query_id)
 JOIN (SELECT query_id, sum(1 / log2(r + 1)) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id) AS r FROM ranked WHERE label = q_label) WHERE r <= 10 GROUP BY query_id) USING (query_id)""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, precision, hit, reciprocal rank and nDCG of the vector ranking, by equal labels."""
    ranking, queries = _labelled(spark, d, 10)
    return metrics.counted_metrics(ranking, queries.select("query_id", "n_gold"), 10)


@R.query(_KNN + """SELECT query_id, round(avg(hit), 6) AS evidence_recall, min(hit) = 1 AS all_evidence FROM (SELECT query_id, id % 3 AS evidence_id, max(CAST(rank <= 10 AS INT)) AS hit FROM ranked WHERE label = q_label GROUP BY ALL) GROUP BY query_id""")
def evidence_recall(spark: SparkSession, d: str) -> DataFrame:
    """Groups of evidence of which any member will do."""
    ranking, queries = _labelled(spark, d, 10)
    part = lambda c: (F.col(c) % 3).alias("evidence_id")
    members = table(spark, d, "embeddings").groupBy("label", part("vec_id")).agg(F.count("*").alias("n"))
    groups = queries.join(members, "label").filter(F.col("n") > (F.col("query_id") % 3 == F.col("evidence_id")).cast("int")).select("query_id", "evidence_id")
    hits = ranking.filter("relevant").select("query_id", part("doc_id"), F.lit(1).alias("hit")).distinct()
    each = groups.join(hits, ["query_id", "evidence_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return each.groupBy("query_id").agg(F.round(F.avg("hit"), 6).alias("evidence_recall"), (F.min("hit") == 1).alias("all_evidence"))


@R.query(_KNN + """SELECT q_label AS label, round(avg(n_hit / n_gold), 6) AS recall, count(*) AS n FROM (SELECT query_id, q_label, count(*) FILTER (rank <= 10 AND label = q_label) AS n_hit, count(*) FILTER (label = q_label) AS n_gold FROM ranked GROUP BY ALL) WHERE n_gold > 0 GROUP BY GROUPING SETS ((), (q_label))""")
def macro_by_category(spark: SparkSession, d: str) -> DataFrame:
    """A5: macro means, overall and by category, from one pass."""
    ranking, queries = _labelled(spark, d, 10)
    hits = ranking.groupBy("query_id").agg(F.count_if("relevant").alias("n_hit"))
    counted = queries.filter("n_gold > 0").join(hits, "query_id", "left").select("label", (F.coalesce("n_hit", F.lit(0)) / F.col("n_gold")).alias("recall"))
    return counted.groupingSets([[], ["label"]], "label").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("n"))


@R.query(_ARMS + "SELECT query_id, round(count(b.doc_id) / 10, 6) AS overlap FROM (SELECT * FROM lists WHERE method = 'bm25' AND rank <= 10) a LEFT JOIN (SELECT query_id, doc_id FROM lists WHERE method = 'grep' AND rank <= 10) b USING (query_id, doc_id) GROUP BY query_id")
def ranking_overlap(spark: SparkSession, d: str) -> DataFrame:
    """V7: overlap of two rankings."""
    lists = _lists(spark, d)
    return metrics.overlap_at(lists.filter("method = 'bm25'"), lists.filter("method = 'grep'"), 10)
