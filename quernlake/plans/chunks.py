"""Queries of chunking, sessions and windows of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernlake.functions.text import squeeze
from quernlake.operators import chunking as C
from quernlake.operators.ordered import gap_over, with_group_starts
from quernlake.plans.registry import Registry
from quernlake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""SELECT id, CAST(s AS BIGINT) AS start_at, substr(content, s + 1, 1200) AS piece FROM (SELECT id, content, unnest(range(0, 1000 * CAST(greatest(0, ceil((length(content) - 1200) / 1000.0)) AS BIGINT) + 1, 1000)) AS s FROM document_chunks WHERE length(content) > 0)""")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1200 characters every 1000."""
    df = table(spark, d, "document_chunks").select("id", F.explode(C.fixed_windows(F.col("content"), 1200, 1000)).alias("w"))
    return df.select("id", F.col("w.start_at").cast("bigint").alias("start_at"), F.col("w.text").alias("piece"))


@R.query("""SELECT id, 'chunk-' || i AS label, trim(substr(content, CAST(i AS BIGINT) * 700 + 1, 800), ' ') AS piece FROM (SELECT id, content, unnest(range(0, CAST(greatest(0, ceil((length(content) - 800) / 700.0)) AS BIGINT) + 1)) AS i FROM document_chunks WHERE length(content) > 0)""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Labelled windows with an overlap."""
    df = table(spark, d, "document_chunks").select("id", F.posexplode(C.fixed_windows(F.col("content"), 800, 700)).alias("i", "w"))
    return df.select("id", F.concat(F.lit("chunk-"), F.col("i").cast("string")).alias("label"), F.trim("w.text").alias("piece"))


@R.query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS n, section FROM (SELECT doc_id, unnest(p) AS section, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{1,3} )', chr(1) || '\\1', 'g'), chr(1)) AS p FROM documents)) WHERE trim(section, ' ') <> ''""")
def chunk_heading(spark: SparkSession, d: str) -> DataFrame:
    """Sections by heading."""
    df = table(spark, d, "documents").select("doc_id", F.posexplode(C.by_heading(F.col("text"))).alias("n", "section"))
    return df.withColumn("n", F.col("n").cast("bigint"))


@R.query()
def chunk_paragraph_pack(spark: SparkSession, d: str) -> DataFrame:
    """C4: paragraphs packed up to 700 characters, longer ones cut with an overlap of 100."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(C.packed_paragraphs(F.col("text"), 700, 100)).alias("n", "piece"))


@R.query()
def chunk_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that end at blank lines or lines."""
    return C.at_boundaries(table(spark, d, "document_chunks").select("id", F.col("content").alias("text")).filter("text is not null"), 1200, 150)


@R.query("""SELECT id, left(sha256(source || ':' || CAST(chunk_index AS VARCHAR)), 20) AS key, sha1(content) AS text_hash FROM document_chunks WHERE source IS NOT NULL AND chunk_index IS NOT NULL""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids by hash."""
    df = table(spark, d, "document_chunks").filter("source is not null and chunk_index is not null")
    return df.select("id", C.chunk_id(F.col("source"), F.col("chunk_index").cast("string")).alias("key"), F.sha1("content").alias("text_hash"))


@R.query("""SELECT id, concat_ws(chr(10) || chr(10), concat_ws(' > ', source, nullif(trim(title, ' '), '')), content) AS input FROM document_chunks""")
def embed_input(spark: SparkSession, d: str) -> DataFrame:
    """C14: text with its title in front."""
    head = F.concat_ws(" > ", F.col("source"), F.nullif(F.trim("title"), F.lit("")))
    return table(spark, d, "document_chunks").select("id", F.concat_ws("\n\n", head, F.col("content")).alias("input"))


@R.query("""SELECT id, concat_ws(chr(10), 'name: ' || nullif(trim(name, ' '), ''), 'room: ' || room_id, 'role: ' || speaker_role) AS document FROM members""")
def row_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows as key: value documents, without blanks."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v.cast("string"))
    parts = F.concat_ws("\n", line("name", F.nullif(F.trim("name"), F.lit(""))), line("room", F.col("room_id")), line("role", F.col("speaker_role")))
    return table(spark, d, "members").select("id", parts.alias("document"))


# Positions of rooms: the first delivery of each.
_POS = """WITH pos AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY room_id, seq ORDER BY id) = 1) """


def _positions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The first delivery of each position, with the columns that are asked for: others never leave the scan."""
    rows = table(spark, d, "messages").groupBy("room_id", "seq").agg(F.min_by(F.struct("id", *columns), "id").alias("m"))
    return rows.select("room_id", "seq", "m.*")


@R.query(_POS + """SELECT room_id, start_seq, count(*) AS n, min(sent_at) AS first_at, max(sent_at) AS last_at FROM (SELECT *, max(CASE WHEN brk THEN seq END) OVER (PARTITION BY room_id ORDER BY seq) AS start_seq FROM
 (SELECT *, coalesce(date_diff('second', lag(sent_at) OVER (PARTITION BY room_id ORDER BY seq), sent_at) > 1800, true) AS brk FROM pos)) GROUP BY ALL""")
def sessions_30m(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of rooms at gaps of more than 30 minutes."""
    rows = with_group_starts(_positions(spark, d, "sent_at"), ["room_id"], "seq", lambda b: gap_over(F.col("sent_at"), b["sent_at"], 30), ["sent_at"])
    return rows.groupBy("room_id", F.col("group_start").alias("start_seq")).agg(F.count("*").alias("n"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))


@R.query(_POS + """SELECT room_id, start_seq, sender_id, count(*) AS n, string_agg(text, chr(10) ORDER BY seq) AS text FROM (SELECT *, max(CASE WHEN brk THEN seq END) OVER (PARTITION BY room_id ORDER BY seq) AS start_seq FROM
 (SELECT *, coalesce(lag(sender_id) OVER w IS DISTINCT FROM sender_id OR date_diff('second', lag(sent_at) OVER w, sent_at) > 300 OR lag(seq) OVER w IS NULL, true) AS brk FROM pos WINDOW w AS (PARTITION BY room_id ORDER BY seq))) GROUP BY ALL""")
def same_sender_merge(spark: SparkSession, d: str) -> DataFrame:
    """Messages of one sender within five minutes become one."""
    new = lambda b: ~b["sender_id"].eqNullSafe(F.col("sender_id")) | gap_over(F.col("sent_at"), b["sent_at"], 5)
    rows = with_group_starts(_positions(spark, d, "sent_at", "sender_id", "text"), ["room_id"], "seq", new, ["sender_id", "sent_at"])
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "text"))))
    merged = rows.groupBy("room_id", F.col("group_start").alias("start_seq"), "sender_id").agg(F.count("*").alias("n"), texts.alias("t"))
    return merged.select("room_id", "start_seq", "sender_id", "n", F.when(F.size("t") > 0, F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("text"))


@R.query()
def chunk_session_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows of up to 30 messages and 700 characters in sessions, overlapping by three messages."""
    usable = _positions(spark, d, "sent_at", "sender_id", "msg_type", "text").filter("msg_type in ('text', 'link') and text is not null")
    rows = with_group_starts(usable, ["room_id"], "seq", lambda b: gap_over(F.col("sent_at"), b["sent_at"], 30), ["sent_at"])
    return C.session_windows(rows.select("room_id", F.col("group_start").alias("session"), "seq", F.col("sender_id").cast("string").alias("sender"), "text"), 30, 700, 3)


@R.query(_POS + """, s AS (SELECT *, max(CASE WHEN brk THEN seq END) OVER (PARTITION BY room_id ORDER BY seq) AS start_seq FROM (SELECT *, coalesce(date_diff('second', lag(sent_at) OVER (PARTITION BY room_id ORDER BY seq), sent_at) > 7200, true) AS brk FROM pos)),
 n AS (SELECT *, row_number() OVER (PARTITION BY room_id, start_seq ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY room_id, start_seq) AS size FROM s)
 SELECT room_id, start_seq, CAST(w AS BIGINT) AS window_no, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_messages FROM (SELECT *, unnest(range(greatest(0, (i - 11 + 8) // 9), i // 9 + 1)) AS w FROM n) WHERE w = 0 OR w * 9 + 3 < size GROUP BY ALL""")
def count_window_gap(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 12 messages overlapping by 3, broken at gaps of over two hours."""
    rows = with_group_starts(_positions(spark, d, "sent_at"), ["room_id"], "seq", lambda b: gap_over(F.col("sent_at"), b["sent_at"], 120), ["sent_at"])
    w = W.partitionBy("room_id", "group_start")
    n = rows.withColumn("i", F.row_number().over(w.orderBy("seq")) - 1).withColumn("size", F.count("*").over(w))
    first = F.greatest(F.lit(0), F.floor((F.col("i") - 11 + 8) / 9).cast("int"))
    each = n.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("i") / 9).cast("int"))))
    each = each.filter((F.col("w") == 0) | (F.col("w") * 9 + 3 < F.col("size")))
    return each.groupBy("room_id", F.col("group_start").alias("start_seq"), F.col("w").cast("bigint").alias("window_no")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_messages"))


@R.query("""SELECT doc_id, start_line, hits FROM (SELECT doc_id, i AS start_line, CAST(sum(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS BIGINT) AS hits FROM
 (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS i, len(regexp_extract_all(lower(unnest(l)), 'plan|policy|계획|정책')) AS h FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, start_line) = 1""")
def best_window(spark: SparkSession, d: str) -> DataFrame:
    """The first run of six lines with most keywords; within the row, without a shuffle."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    hits = lines.select("doc_id", F.transform("l", lambda x: F.regexp_count(F.lower(x), F.lit("plan|policy|계획|정책"))).alias("h"))
    sums = F.transform("h", lambda x, i: F.struct(F.aggregate(F.slice("h", i + 1, F.lit(6)), F.lit(0), lambda a, y: a + y).alias("hits"), (-i).alias("at")))
    best = hits.select("doc_id", F.array_max(sums).alias("b"))
    return best.select("doc_id", (-F.col("b.at")).cast("bigint").alias("start_line"), F.col("b.hits").cast("bigint").alias("hits"))


@R.query("""SELECT source, batch, count(*) AS n FROM (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS batch FROM documents) GROUP BY ALL""")
def batch_packing(spark: SparkSession, d: str) -> DataFrame:
    """Batches of twenty; only the sizes of the sources decide, so no row is numbered."""
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("size"))
    batches = n.select("source", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / 20))).alias("batch"))
    return batches.select("source", "batch", F.least(F.lit(20).cast("bigint"), F.col("size") - F.col("batch") * 20).alias("n"))


@R.query("""SELECT id, count(*) AS n_lines, CAST(max(length(l)) AS BIGINT) AS longest FROM (SELECT id, trim(regexp_replace(unnest(string_split(content, chr(10))), '[\\s\\x{00A0}]+', ' ', 'g')) AS l FROM document_chunks) WHERE l <> '' GROUP BY id""")
def block_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of chunks as blocks."""
    blocks = F.filter(F.transform(F.split("content", "\n"), lambda x: squeeze(x)), lambda x: x != "")
    df = table(spark, d, "document_chunks").select("id", blocks.alias("b")).filter(F.size("b") > 0)
    return df.select("id", F.size("b").cast("bigint").alias("n_lines"), F.array_max(F.transform("b", lambda x: F.length(x))).cast("bigint").alias("longest"))
