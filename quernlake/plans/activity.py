"""Queries of activity analytics, judging and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernlake.functions.text import shares_window, words
from quernlake.operators import activity as A
from quernlake.plans.registry import Registry
from quernlake.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("member"), "ts", F.col("event_type").alias("kind"), "value")


_DAYS = "WITH days AS (SELECT user_id AS member, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)"


@R.query(_DAYS + """ SELECT m.member, g.day, coalesce(days.n, 0) AS n FROM (SELECT DISTINCT member FROM days) m CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT max(day) FROM days) - 83, (SELECT max(day) FROM days), INTERVAL 1 DAY)) AS DATE) AS day) g LEFT JOIN days ON days.member = m.member AND days.day = g.day""")
def heatmap_84d(spark: SparkSession, d: str) -> DataFrame:
    """A dense calendar of twelve weeks."""
    return A.heatmap(A.daily(_events(spark, d)), 84)


_ISLANDS = _DAYS + """, isl AS (SELECT member, min(day) AS first_day, max(day) AS last_day, count(*) AS length FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY member ORDER BY day) AS INT) AS i FROM days) GROUP BY member, i)"""


@R.query(_ISLANDS + " SELECT member, coalesce(max(length) FILTER (last_day >= (SELECT max(day) FROM days) - 1), 0) AS current, max(length) AS longest FROM isl GROUP BY member")
def streaks(spark: SparkSession, d: str) -> DataFrame:
    """Current and longest streaks."""
    days = A.daily(_events(spark, d))
    last = days.agg(F.max("day").alias("d")).first().d
    return A.current_streaks(A.streaks(days), F.lit(last))


@R.query(_ISLANDS + " SELECT 'streak' AS milestone, member, last_day AS day, length AS size FROM isl WHERE length >= 3 UNION ALL SELECT 'busy', member, day, n FROM days WHERE n >= 8")
def milestones(spark: SparkSession, d: str) -> DataFrame:
    """D3: streaks of three days and busy days."""
    days = A.daily(_events(spark, d))
    runs = A.streaks(days).filter("length >= 3").select(F.lit("streak").alias("milestone"), "member", F.col("last_day").alias("day"), F.col("length").alias("size"))
    return runs.unionByName(days.filter("n >= 8").select(F.lit("busy").alias("milestone"), "member", "day", F.col("n").alias("size")))


@R.query("""SELECT member, day, n, kinds, place FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY day DESC) AS place FROM (SELECT user_id AS member, CAST(ts AS DATE) AS day, count(*) AS n, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY ALL)) WHERE place <= 3""")
def feed_top3(spark: SparkSession, d: str) -> DataFrame:
    """The last three days of each member."""
    days = _events(spark, d).groupBy("member", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return A.first_per_group(days, ["member"], [F.desc("day")], 3)


@R.query("""SELECT user_id AS member, count(*) AS n, CAST(sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) AS BIGINT) AS xp, CAST(floor(sqrt(sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) / 10)) AS BIGINT) + 1 AS level FROM events GROUP BY user_id""")
def xp_levels(spark: SparkSession, d: str) -> DataFrame:
    """Points and levels by counts."""
    points = F.sum(F.when(F.col("kind") == "purchase", 5).when(F.col("kind") == "signup", 3).when(F.col("kind") == "click", 2).otherwise(1))
    g = _events(spark, d).groupBy("member").agg(F.count("*").alias("n"), points.alias("xp"))
    return g.withColumn("level", F.floor(F.sqrt(F.col("xp") / 10)).cast("bigint") + 1)


@R.query("""WITH s1 AS (SELECT user_id AS m, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY user_id), s2 AS (SELECT m, min(e.ts) AS t FROM s1 JOIN events e ON e.user_id = m AND e.event_type = 'view' AND e.ts >= s1.t GROUP BY m),
 s3 AS (SELECT m, min(e.ts) AS t FROM s2 JOIN events e ON e.user_id = m AND e.event_type = 'purchase' AND e.ts >= s2.t GROUP BY m)
 SELECT 1 AS step, 'signup' AS kind, count(*) AS n FROM s1 UNION ALL SELECT 2, 'view', count(*) FROM s2 UNION ALL SELECT 3, 'purchase', count(*) FROM s3""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    """An ordered funnel."""
    return A.funnel(_events(spark, d), ["signup", "view", "purchase"])


@R.query(_DAYS + " SELECT a.day, count(*) AS n, count(b.member) AS next_day FROM days a LEFT JOIN days b ON b.member = a.member AND b.day = a.day + 1 GROUP BY a.day")
def d1_retention(spark: SparkSession, d: str) -> DataFrame:
    """Members who come back the next day, by a look ahead instead of a join."""
    days = A.daily(_events(spark, d))
    nxt = F.lead("day").over(W.partitionBy("member").orderBy("day"))
    return days.withColumn("back", nxt == F.date_add("day", 1)).groupBy("day").agg(F.count("*").alias("n"), F.count_if("back").alias("next_day"))


@R.query("""SELECT user_id AS member, round(CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view') END, 6) AS click_rate, round(CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type = 'click') END, 6) AS buy_rate FROM events GROUP BY user_id""")
def rates(spark: SparkSession, d: str) -> DataFrame:
    """A10: ratios that are null rather than fail."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return _events(spark, d).groupBy("member").agg(F.round(F.try_divide(n("click"), n("view")), 6).alias("click_rate"), F.round(F.try_divide(n("purchase"), n("click")), 6).alias("buy_rate"))


@R.query("""SELECT msg_type, count(*) AS n, count(DISTINCT room_id) AS rooms, count(*) FILTER (sender_id IS NULL) AS unsent FROM messages GROUP BY msg_type""")
def group_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters by type."""
    return table(spark, d, "messages").groupBy("msg_type").agg(F.count("*").alias("n"), F.count_distinct("room_id").alias("rooms"), F.count_if(F.col("sender_id").isNull()).alias("unsent"))


@R.query("""SELECT room_id, median(lag_s) AS median_s, list_sort(list(lag_s))[len(list(lag_s)) // 2 + 1] AS upper_s, round(avg(lag_s), 6) AS mean_s FROM (SELECT room_id, CAST(date_diff('second', sent_at, CAST(loaded_at AS TIMESTAMP)) AS BIGINT) AS lag_s FROM messages) GROUP BY room_id""")
def median_latency(spark: SparkSession, d: str) -> DataFrame:
    """Median, upper median and mean of the time to load."""
    lag = F.timestamp_diff("SECOND", F.col("sent_at"), F.col("loaded_at").cast("timestamp_ntz")).cast("bigint")
    df = table(spark, d, "messages").select("room_id", lag.alias("lag_s"))
    # A histogram a room: equal lags are counted before anything is shuffled, and places are read off the running count.
    n = df.groupBy("room_id", "lag_s").agg(F.count("*").alias("n"))
    w = W.partitionBy("room_id")
    placed = n.withColumn("upto", F.sum(F.when(F.col("lag_s").isNotNull(), F.col("n")).otherwise(0)).over(w.orderBy(F.asc_nulls_last("lag_s")))).withColumn("all", F.sum(F.when(F.col("lag_s").isNotNull(), F.col("n"))).over(w))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("lag_s")))
    half = F.floor(F.col("all") / 2)
    middle = placed.groupBy("room_id").agg(at(F.floor((F.col("all") - 1) / 2)).alias("low"), at(half).alias("upper_s"), F.sum(F.col("lag_s") * F.col("n")).alias("total"), F.max("all").alias("all"))
    return middle.select("room_id", ((F.col("low") + F.col("upper_s")) / 2).alias("median_s"), "upper_s", F.round(F.col("total") / F.col("all"), 6).alias("mean_s"))


@R.query("""SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE lang IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first_id) = 1""")
def label_mode(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent label, the first seen of equals."""
    n = table(spark, d, "documents").filter("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    best = n.groupBy("source").agg(F.min_by(F.struct("lang", "n"), F.struct(-F.col("n"), "first_id")).alias("b"))
    return best.select("source", "b.lang", "b.n")


@R.query("""SELECT doc_id, CASE WHEN n_area >= 2 THEN area ELSE 'partial' END AS verdict FROM (SELECT doc_id, area, count(*) OVER (PARTITION BY doc_id, area) AS n_area FROM subject_labels) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_area DESC, area NULLS LAST) = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """The label that two votes agree on, else partial."""
    n = table(spark, d, "subject_labels").groupBy("doc_id", "area").agg(F.count("*").alias("n"))
    best = n.groupBy("doc_id").agg(F.min_by(F.struct("area", "n"), F.struct((-F.col("n")).alias("v"), F.col("area").isNull().alias("z"), "area")).alias("b"))
    return best.select("doc_id", F.when(F.col("b.n") >= 2, F.col("b.area")).otherwise("partial").alias("verdict"))


@R.query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five documents a source, in hash order."""
    return A.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@R.query("""SELECT cohort, count(*) AS n FROM (SELECT user_id, CASE WHEN min(ts) < (SELECT min(ts) + INTERVAL 7 DAY FROM events) THEN 'first week' ELSE 'later' END AS cohort FROM events GROUP BY user_id) GROUP BY cohort""")
def cohort_assign(spark: SparkSession, d: str) -> DataFrame:
    """Members by the week they came."""
    first = _events(spark, d).groupBy("member").agg(F.min("ts").alias("t"))
    begin = first.agg(F.min("t").alias("t")).first().t
    edge = F.lit(begin).cast("timestamp_ntz") + F.expr("interval 7 days")
    return first.groupBy(F.when(F.col("t") < edge, "first week").otherwise("later").alias("cohort")).agg(F.count("*").alias("n"))


@R.query("""SELECT source, week, count(*) AS n, count(DISTINCT member_id) AS members FROM (SELECT source, member_id, date_trunc('week', published_at) AS week FROM documents) GROUP BY ALL""")
def readings_by_week(spark: SparkSession, d: str) -> DataFrame:
    """Documents and members by week."""
    week = F.date_trunc("week", F.col("published_at"))
    return table(spark, d, "documents").groupBy("source", week.alias("week")).agg(F.count("*").alias("n"), F.count_distinct("member_id").alias("members"))


@R.query("""SELECT d.source, count(*) AS n, CAST(sum(len(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+'))) AS BIGINT) AS n_words FROM documents d WHERE NOT EXISTS (SELECT 1 FROM subject_labels s WHERE s.doc_id = d.doc_id) GROUP BY d.source""")
def backlog_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """What no label maps yet, with word counts."""
    open_ = table(spark, d, "documents").join(table(spark, d, "subject_labels").select("doc_id").distinct(), "doc_id", "left_anti")
    return open_.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size(words(F.when(F.col("text").isNotNull(), F.col("text"))))).alias("n_words"))


def _authors(spark: SparkSession, d: str, source: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("source") == source).select("member_id").distinct()


@R.query("SELECT member_id FROM documents WHERE source = 'wiki' INTERSECT SELECT member_id FROM documents WHERE source = 'vault'")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    """O6."""
    return _authors(spark, d, "wiki").join(_authors(spark, d, "vault"), "member_id", "left_semi")


@R.query("SELECT member_id FROM documents WHERE source = 'wiki' EXCEPT SELECT member_id FROM documents WHERE source = 'newsroom'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    """O7."""
    return _authors(spark, d, "wiki").join(_authors(spark, d, "newsroom"), "member_id", "left_anti")


@R.query("SELECT member_id FROM documents WHERE source = 'wiki' UNION SELECT member_id FROM documents WHERE source = 'repo'")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    """O5."""
    return _authors(spark, d, "wiki").unionByName(_authors(spark, d, "repo")).distinct()


@R.query("""SELECT member, before_s, after_s, after_s - before_s AS delta FROM (SELECT user_id AS member, round(sum(value) FILTER (event_type = 'view'), 4) AS before_s, round(sum(value) FILTER (event_type = 'purchase'), 4) AS after_s FROM events GROUP BY user_id)""".replace("after_s - before_s AS delta", "round(after_s - before_s, 4) AS delta"))
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """The difference between paired measures."""
    s = lambda k: F.round(F.sum(F.when(F.col("kind") == k, F.col("value"))), 4)
    g = _events(spark, d).groupBy("member").agg(s("view").alias("before_s"), s("purchase").alias("after_s"))
    return g.withColumn("delta", F.round(F.col("after_s") - F.col("before_s"), 4))


@R.query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """A1: grouped sums behind a filter that reaches the scan."""
    df = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@R.query("""SELECT n_name, p_type, count(DISTINCT s_suppkey) AS suppliers, count(*) AS uses FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    """A star of equality joins; the fact is counted by its keys before it meets the dimensions."""
    uses = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("k"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    sup = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    j = uses.join(part, "l_partkey").join(sup, "l_suppkey")
    return j.groupBy("n_name", "p_type").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.sum("k").alias("uses"))


@R.query("""SELECT a, b, shared FROM (SELECT a.id AS a, b.id AS b, round(greatest(0, least(a.end_seq, b.end_seq) - greatest(a.start_seq, b.start_seq) + 1) / least(a.end_seq - a.start_seq + 1, b.end_seq - b.start_seq + 1), 6) AS shared
 FROM chunks a JOIN chunks b ON a.room_id = b.room_id AND a.id < b.id AND a.start_seq <= b.end_seq AND b.start_seq <= a.end_seq) WHERE shared >= 0.5""")
def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a room that overlap by half of the shorter: an equality join on blocks of 64
    positions, each pair kept in the block where its overlap begins."""
    c = table(spark, d, "chunks").filter("start_seq is not null and end_seq >= start_seq").select("id", "room_id", "start_seq", "end_seq")
    blocks = c.withColumn("block", F.explode(F.sequence(F.shiftright("start_seq", 6), F.shiftright("end_seq", 6))))
    x, y = blocks.alias("x"), blocks.alias("y")
    start = F.greatest("x.start_seq", "y.start_seq")
    both = (F.col("x.room_id") == F.col("y.room_id")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.id") < F.col("y.id"))
    j = x.join(y, both).filter((F.shiftright(start, 6) == F.col("x.block")) & (start <= F.least("x.end_seq", "y.end_seq")))
    length = F.least(F.col("x.end_seq") - F.col("x.start_seq"), F.col("y.end_seq") - F.col("y.start_seq")) + 1
    shared = F.round((F.least("x.end_seq", "y.end_seq") - start + 1) / length, 6)
    return j.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), shared.alias("shared")).filter("shared >= 0.5")


# Answers under review: evidence of statements stands in for claims, their confidence for the verdict.
@R.query("""SELECT run, category, n, round(n_ok / n, 6) AS accuracy, round(score / n, 6) AS score FROM (SELECT coalesce(extraction_run, 'all') AS run, coalesce(predicate, 'all') AS category, n, n_ok, score FROM (SELECT extraction_run, predicate, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS n_ok, sum(CASE WHEN confidence >= 0.8 THEN 1 WHEN confidence >= 0.5 THEN 0.5 ELSE 0 END) AS score
 FROM edges WHERE extraction_run IS NOT NULL AND predicate IS NOT NULL AND confidence IS NOT NULL GROUP BY GROUPING SETS ((extraction_run), (extraction_run, predicate))))""")
def grading_summary(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and scores, overall and by category, from one pass."""
    e = table(spark, d, "edges").dropna(subset=["extraction_run", "predicate", "confidence"])
    score = F.when(F.col("confidence") >= 0.8, 1.0).when(F.col("confidence") >= 0.5, 0.5).otherwise(0.0)
    g = e.withColumn("score", score).groupingSets([["extraction_run"], ["extraction_run", "predicate"]], "extraction_run", "predicate")
    g = g.agg(F.count("*").alias("n"), F.count_if(F.col("score") == 1).alias("n_ok"), F.sum("score").alias("s"))
    return g.select(F.coalesce("extraction_run", F.lit("all")).alias("run"), F.coalesce("predicate", F.lit("all")).alias("category"), "n", F.round(F.col("n_ok") / F.col("n"), 6).alias("accuracy"), F.round(F.col("s") / F.col("n"), 6).alias("score"))


@R.query("""SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (cited) AS n_cited, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (cited) / count(*), 6) END AS coverage FROM
 (SELECT doc_id, regexp_matches(s, '[A-Z][0-9]{1,3}') AS cited FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))), '[\\s\\x{00A0}]+', ' ', 'g'), ' ') AS s FROM documents) WHERE regexp_matches(s, '[.!?]\\z')) GROUP BY doc_id""")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with a reference mark; within the row."""
    from quernlake.functions.text import sentences

    s = F.filter(sentences(F.col("text")), lambda x: x.rlike(r"[.!?]\z"))
    df = table(spark, d, "documents").select("doc_id", s.alias("s")).filter(F.size("s") > 0)
    cited = F.size(F.filter("s", lambda x: x.rlike("[A-Z][0-9]{1,3}"))).cast("bigint")
    return df.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), cited.alias("n_cited"), F.round(cited / F.size("s"), 6).alias("coverage"))


@R.query("""SELECT c.id, count(DISTINCT e.evidence) AS n_copied FROM (SELECT DISTINCT chunk_id, evidence FROM edges) e JOIN document_chunks c ON c.id = e.chunk_id
 WHERE len(list_filter(range(1, length(e.evidence) - 48), lambda i: contains(c.content, substring(e.evidence, i, 50)))) > 0 GROUP BY c.id""")
def verbatim_copy(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of which any 50 characters in a row stand in its chunk word for word."""
    e = table(spark, d, "edges").select(F.col("chunk_id").alias("id"), "evidence").distinct()
    c = table(spark, d, "document_chunks").select("id", "content")
    return e.join(c, "id").filter(shares_window(F.col("evidence"), F.col("content"), 50)).groupBy("id").agg(F.count_distinct("evidence").alias("n_copied"))


@R.query("""SELECT q, CASE WHEN regexp_matches(q, '(?i)^\\s*(select|with)\\b') AND NOT regexp_matches(q, '(?i)\\b(insert|update|delete|drop|alter|create|truncate|merge|grant|revoke|call|copy|load|set|execute|exec|vacuum|attach|detach|install|export|import|replace|foreach|remove)\\b') AND NOT contains(q, ';') AND NOT contains(q, '--') THEN 'allowed' ELSE 'refused' END AS verdict
 FROM (VALUES ('SELECT * FROM documents LIMIT 5'), ('with a as (select 1) select * from a'), ('DROP TABLE documents'), ('SELECT 1; DELETE FROM a'), ('select * from t -- all'), ('UPDATE a SET b = 1'), ('GRANT ALL ON t TO x'), ('with a as (select 1) call p()'), ('select 1 into x; copy t to y')) v(q)""")
def query_guard(spark: SparkSession, d: str) -> DataFrame:
    """Read-only queries by rule."""
    texts = ["SELECT * FROM documents LIMIT 5", "with a as (select 1) select * from a", "DROP TABLE documents", "SELECT 1; DELETE FROM a", "select * from t -- all", "UPDATE a SET b = 1", "GRANT ALL ON t TO x", "with a as (select 1) call p()", "select 1 into x; copy t to y"]
    q = F.col("q")
    fine = q.rlike(r"(?i)^\s*(select|with)\b") & ~q.rlike(r"(?i)\b(insert|update|delete|drop|alter|create|truncate|merge|grant|revoke|call|copy|load|set|execute|exec|vacuum|attach|detach|install|export|import|replace|foreach|remove)\b") & ~q.contains(";") & ~q.contains("--")
    return spark.createDataFrame([(t,) for t in texts], "q string").select("q", F.when(fine, "allowed").otherwise("refused").alias("verdict"))


@R.query("""SELECT doc_id, CASE WHEN regexp_matches(lower(title), 'how many|몇|총') THEN 'aggregate' WHEN regexp_matches(lower(title), 'relation|관계|비교|compare') THEN 'graph' WHEN regexp_matches(lower(title), 'plan|policy|계획') THEN 'local' ELSE 'search' END AS route FROM documents WHERE title IS NOT NULL""")
def route_question(spark: SparkSession, d: str) -> DataFrame:
    """T-family: a rule-based router."""
    t = F.lower("title")
    route = F.when(t.rlike("how many|몇|총"), "aggregate").when(t.rlike("relation|관계|비교|compare"), "graph").when(t.rlike("plan|policy|계획"), "local").otherwise("search")
    return table(spark, d, "documents").filter("title is not null").select("doc_id", route.alias("route"))
