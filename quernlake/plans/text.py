"""Queries of text parsing and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernlake.functions import text as X
from quernlake.plans.registry import Registry
from quernlake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _sql_masks() -> tuple[str, list[str]]:
    expr, counts = "text", []
    for label, pattern in X.MASKS:
        counts.append(f"sum(len(regexp_extract_all({expr}, '{pattern}'))) AS n_{label}")
        expr = f"regexp_replace({expr}, '{pattern}', '[{label}]', 'g')"
    return expr, counts


_MASKED, _MASK_COUNTS = _sql_masks()


@R.query("SELECT lang, count(*) AS n, CAST(sum(length(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')))) AS BIGINT) AS squeezed, CAST(sum(length(regexp_replace(text, '[\\s\\x{00A0}]+', '', 'g'))) AS BIGINT) AS bare FROM documents GROUP BY lang")
def whitespace_norm(spark: SparkSession, d: str) -> DataFrame:
    """Lengths after squeezing and after deleting whitespace."""
    t = F.col("text")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length(X.squeeze(t))).alias("squeezed"), F.sum(F.length(X.without_whitespace(t))).alias("bare"))


@R.query(f"SELECT id, {_MASKED} AS masked FROM messages")
def pii_mask(spark: SparkSession, d: str) -> DataFrame:
    """The ordered masking rules."""
    return table(spark, d, "messages").select("id", X.masked(F.col("text"))[0].alias("masked"))


@R.query(f"SELECT msg_type, {', '.join(f'CAST({c.split(" AS ")[0]} AS BIGINT) AS {c.split(" AS ")[1]}' for c in _MASK_COUNTS)} FROM messages GROUP BY msg_type")
def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each rule on what earlier rules left."""
    counts = X.masked(F.col("text"))[1]
    return table(spark, d, "messages").groupBy("msg_type").agg(*(F.sum(c).alias(f"n_{k}") for k, c in counts.items()))


_SECRET = "content"
for _label, _pattern in X.SECRETS:
    _SECRET = f"regexp_replace({_SECRET}, '{_pattern}', '[{_label}]', 'g')"


@R.query(f"SELECT id, {_SECRET} AS redacted FROM document_chunks")
def secret_redact(spark: SparkSession, d: str) -> DataFrame:
    """Secrets cut out of texts."""
    return table(spark, d, "document_chunks").select("id", X.masked(F.col("content"), X.SECRETS)[0].alias("redacted"))


@R.query("""SELECT kind, msg_type, count(*) AS n FROM (SELECT msg_type, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty'
 WHEN regexp_matches(trim(text, ' '), '^삭제된 메시지입니다\\.?$') THEN 'deleted' WHEN regexp_matches(trim(text, ' '), '^(사진( [0-9]+장)?|동영상|이모티콘|음성메시지|파일: .*)$') THEN 'media'
 WHEN regexp_matches(trim(text, ' '), '^https?://[^ \\n]+$') THEN 'link' ELSE 'text' END AS kind FROM messages) GROUP BY ALL""")
def msg_type(spark: SparkSession, d: str) -> DataFrame:
    """T4: message kinds against the stored type."""
    return table(spark, d, "messages").groupBy(X.message_kind(F.col("text")).alias("kind"), "msg_type").agg(F.count("*").alias("n"))


@R.query("""SELECT room_id, sender_id, 'user-' || lpad(CAST(dense_rank() OVER (PARTITION BY room_id ORDER BY first_seq, sender_id) AS VARCHAR), 3, '0') AS alias
 FROM (SELECT room_id, sender_id, min(seq) AS first_seq FROM messages WHERE sender_id IS NOT NULL GROUP BY ALL)""")
def pseudonym_ids(spark: SparkSession, d: str) -> DataFrame:
    """T5: senders of a room by first appearance; one row a sender is ranked, not one a message."""
    first = table(spark, d, "messages").filter("sender_id is not null").groupBy("room_id", "sender_id").agg(F.min("seq").alias("first_seq"))
    rank = F.dense_rank().over(W.partitionBy("room_id").orderBy("first_seq", "sender_id"))
    return first.select("room_id", "sender_id", F.concat(F.lit("user-"), F.lpad(rank.cast("string"), 3, "0")).alias("alias"))


@R.query("""SELECT source, CAST(sum(CAST(title IS NOT NULL AS INT)) AS BIGINT) AS titled, count(DISTINCT s) AS slugs, min(s) AS first_slug, max(s) AS last_slug
 FROM (SELECT source, title, regexp_replace(regexp_replace(lower(title), '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM document_chunks) GROUP BY source""")
def slug_titles(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of titles."""
    df = table(spark, d, "document_chunks").select("source", "title", X.slug(F.col("title")).alias("s"))
    return df.groupBy("source").agg(F.count("title").alias("titled"), F.count_distinct("s").alias("slugs"), F.min("s").alias("first_slug"), F.max("s").alias("last_slug"))


@R.query("""SELECT predicate, upper(regexp_replace(camel, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, n FROM
 (SELECT predicate, lower(substr(p, 1, 1)) || substr(p, 2) AS camel, n FROM (SELECT predicate, array_to_string([upper(substr(x, 1, 1)) || lower(substr(x, 2)) FOR x IN string_split(predicate, '_')], '') AS p, count(*) AS n FROM edges GROUP BY ALL))""")
def camel_to_snake(spark: SparkSession, d: str) -> DataFrame:
    """Relation names as camelCase and back."""
    n = table(spark, d, "edges").groupBy("predicate").agg(F.count("*").alias("n"))
    p = F.array_join(F.transform(F.split("predicate", "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")
    camel = F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))
    return n.select("predicate", X.upper_snake(camel).alias("snake"), "n")


@R.query("""SELECT doc_id, CAST(length(regexp_replace(text, '[^\\p{L}]|[A-Za-z가-힣\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}]', '', 'g')) AS BIGINT) AS n_foreign FROM documents
 WHERE length(regexp_replace(text, '[^\\p{L}]|[A-Za-z가-힣\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}]', '', 'g')) > 0""")
def script_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents with letters of other scripts."""
    df = table(spark, d, "documents").select("doc_id", X.foreign_letters(F.col("text")).cast("bigint").alias("n_foreign"))
    return df.filter("n_foreign > 0")


@R.query("""SELECT tag, count(*) AS n_documents FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '#([0-9A-Za-z_가-힣]+)', 1)) AS tag FROM documents) GROUP BY tag""")
def hashtag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hashtags by documents."""
    return table(spark, d, "documents").select(F.explode(X.hashtags(F.col("text"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n_documents"))


@R.query("""SELECT host, path_root, count(*) AS n FROM (SELECT regexp_extract(u, '^https?://([^/?#]+)', 1) AS host, regexp_extract(u, '^https?://[^/?#]+/([^/?#]*)', 1) AS path_root
 FROM (SELECT unnest(regexp_extract_all(text, 'https?://[^\\s<>()"'']+')) AS u FROM documents)) GROUP BY ALL""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Links by host and first part of the path."""
    u = table(spark, d, "documents").select(F.explode(X.urls(F.col("text"))).alias("u"))
    host = F.regexp_extract("u", r"^https?://([^/?#]+)", 1)
    root = F.regexp_extract("u", r"^https?://[^/?#]+/([^/?#]*)", 1)
    return u.groupBy(host.alias("host"), root.alias("path_root")).agg(F.count("*").alias("n"))


@R.query("""SELECT doc_id, key, value FROM (SELECT doc_id, i, regexp_extract(line, '^([A-Za-z_]+):', 1) AS key, trim(regexp_replace(line, '^[A-Za-z_]+:', ''), ' ') AS value,
  row_number() OVER (PARTITION BY doc_id, regexp_extract(line, '^([A-Za-z_]+):', 1) ORDER BY i) AS r
 FROM (SELECT doc_id, unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) AS i FROM (SELECT doc_id, regexp_extract(text, '^\\x{FEFF}?---\\n([\\s\\S]*?)\\n---', 1) AS b FROM documents) WHERE b <> '')
 WHERE regexp_matches(line, '^[A-Za-z_]+:')) WHERE r = 1""")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """The fields of front matter."""
    return table(spark, d, "documents").select("doc_id", F.explode(X.front_matter(F.col("text"))).alias("key", "value"))


@R.query("""SELECT doc_id, coalesce(nullif(trim(title, ' '), ''), h, left(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')), 40)) AS title,
 CASE WHEN nullif(trim(title, ' '), '') IS NOT NULL THEN 'meta' WHEN h IS NOT NULL THEN 'heading' WHEN text IS NOT NULL THEN 'text' END AS origin
 FROM (SELECT *, nullif(trim(regexp_extract(text, '(?m)^#{1,6} +([^\\n]+)$', 1), ' '), '') AS h FROM documents)""")
def title_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Title from the field, the first heading or the text, with where it came from."""
    meta = F.nullif(F.trim("title"), F.lit(""))
    heading = X.first_heading(F.col("text"))
    start = F.left(X.squeeze(F.col("text")), F.lit(40))
    origin = F.when(meta.isNotNull(), "meta").when(heading.isNotNull(), "heading").when(F.col("text").isNotNull(), "text")
    return table(spark, d, "documents").select("doc_id", F.coalesce(meta, heading, start).alias("title"), origin.alias("origin"))


@R.query("""SELECT source, week, count(*) AS n, min(published_at) AS first_at FROM (SELECT source, published_at,
 CAST(floor(date_diff('day', DATE '2014-12-29', CAST(published_at AS DATE)) / 7) + 1 AS BIGINT) AS week FROM documents) GROUP BY ALL""")
def week_bins(spark: SparkSession, d: str) -> DataFrame:
    """Week numbers from a Monday on."""
    week = (F.floor(F.date_diff(F.to_date("published_at"), F.lit("2014-12-29").cast("date")) / 7) + 1).cast("bigint")
    return table(spark, d, "documents").groupBy("source", week.alias("week")).agg(F.count("*").alias("n"), F.min("published_at").alias("first_at"))


@R.query("""SELECT doc_id, CAST(len(b) AS BIGINT) AS n_blocks, array_to_string(b, ' ¶ ') AS blocks FROM (SELECT doc_id, list_filter([trim(regexp_replace(x, '[\\s\\x{00A0}]+', ' ', 'g')) FOR x IN string_split(
 replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '</[A-Za-z0-9]+>|<br ?/?>', chr(10), 'g'), '<[^<>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10))], lambda x: length(x) >= 12) AS b
 FROM documents WHERE regexp_matches(text, '<[a-z]+>'))""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks of markup."""
    df = table(spark, d, "documents").filter(F.col("text").rlike("<[a-z]+>")).select("doc_id", X.html_blocks(F.col("text")).alias("b"))
    return df.select("doc_id", F.size("b").cast("bigint").alias("n_blocks"), F.array_join("b", " ¶ ").alias("blocks"))


@R.query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^```[^\\n]*$', '', 'g'), '!\\[[^\\]\\n]*\\]\\([^)\\n]*\\)', '', 'g'),
 '\\[([^\\]\\n]*)\\]\\([^)\\n]*\\)', '\\1', 'g'), '(?m)^[ \\t]*(#{1,6}|>|[-*+])[ \\t]+', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS plain FROM documents""")
def markdown_clean(spark: SparkSession, d: str) -> DataFrame:
    """Plain text of markdown."""
    return table(spark, d, "documents").select("doc_id", X.clean_markdown(F.col("text")).alias("plain"))


@R.query("""SELECT id, CASE WHEN length(f) > 80 THEN left(f, 80) || '…' ELSE f END AS preview FROM (SELECT id, trim(regexp_replace(content, '[\\s\\x{00A0}]+', ' ', 'g')) AS f FROM document_chunks)""")
def preview_text(spark: SparkSession, d: str) -> DataFrame:
    """Previews of fixed width."""
    return table(spark, d, "document_chunks").select("id", X.preview(F.col("content")).alias("preview"))


@R.query("""SELECT doc_id, count(*) AS n_sentences, CAST(max(length(s)) AS BIGINT) AS longest FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))), '[\\s\\x{00A0}]+', ' ', 'g')) AS s FROM documents) WHERE s <> '' GROUP BY doc_id""")
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of documents; counted in the row, so nothing is shuffled."""
    df = table(spark, d, "documents").select("doc_id", X.sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return df.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("bigint").alias("longest"))


@R.query("""SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct([regexp_replace(lower(trim(x)), '^#+', '') FOR x IN string_split(t, ',') IF regexp_replace(lower(trim(x)), '^#+', '') <> ''])) AS tag
 FROM (SELECT regexp_extract(regexp_extract(text, '^\\x{FEFF}?---\\n([\\s\\S]*?)\\n---', 1), '(?m)^tags:[ ]*\\[([^\\]\\n]*)\\]', 1) AS t FROM documents)) GROUP BY tag""")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Normalised tags of front matter."""
    block = F.regexp_extract("text", r"^\x{FEFF}?---\n([\s\S]*?)\n---", 1)
    tags = F.split(F.regexp_extract(block, r"(?m)^tags:[ ]*\[([^\]\n]*)\]", 1), ",")
    return table(spark, d, "documents").select(F.explode(X.normalised_tags(tags)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@R.query("""SELECT event_type, count(*) AS n, count(v) AS n_clean, round(sum(v), 6) AS total FROM (SELECT event_type, CASE WHEN value >= 0 AND NOT isnan(value) AND value <> 'infinity'::DOUBLE THEN value END AS v FROM events) GROUP BY event_type""")
def clean_observations(spark: SparkSession, d: str) -> DataFrame:
    """Finite non-negative observations only."""
    v = X.clean_number(F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(v).alias("n_clean"), F.round(F.sum(v), 6).alias("total"))
