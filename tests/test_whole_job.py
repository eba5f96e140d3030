"""Results that a cut of the input would change."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from quernlake.functions.text import shares_window
from quernlake.operators import chunking, graph, lexical, ranking
from quernlake.plans import activity, details, further, retrieval, search
from quernlake.plans import graph as plans


def test_communities_over_all_edges(spark, data):
    near: dict[str, set[str]] = {}
    for r in plans._edges(spark, data).filter("src <> dst").collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    assert max(map(len, near.values())) > 20
    label = {n: n for n in near}
    for _ in range(5):
        votes = {n: Counter(label[o] for o in others) for n, others in near.items()}
        label = {n: min(v, key=lambda c: (-v[c], c)) for n, v in votes.items()}
    sizes = {c: n for c, n in Counter(label.values()).items() if n >= 4}
    assert {r.community: r["size"] for r in plans.communities_lpa(spark, data).collect()} == sizes
    m2 = sum(map(len, near.values()))
    inside, degree = Counter(), Counter()
    for n, others in near.items():
        degree[label[n]] += len(others)
        inside[label[n]] += sum(label[o] == label[n] for o in others)
    expected = round(sum(inside[c] / m2 - (degree[c] / m2) ** 2 for c in degree), 6)
    assert abs(plans.communities_modularity(spark, data).first().modularity - expected) < 2e-6


def test_meeting_at_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_ROWS", 5)
    x = spark.createDataFrame([(f"a{n}", "hub" if n < 40 else "m") for n in range(50)], "src string, mid string")
    y = spark.createDataFrame([("hub", "p"), ("hub", "q"), ("m", "p"), ("n", "p")], "mid string, dst string")
    got = sorted((r.src, r.mid, r.dst) for r in graph.meet(x, y, "mid", "src").collect())
    assert got == sorted((a, m, e) for a, m in x.collect() for k, e in y.collect() if m == k)


def test_a_copy_is_found_wherever_it_stands(spark, tmp_path):
    long = "".join(chr(0xAC00 + 7 * n) for n in range(120))
    pairs = [(long, "x" + long[40:90] + "y"), (long, long[40:89] + "#"), (long, long[:30]), (long, long[70:]), (long[:49], long), (long[:50], long), ("", long), (None, long), (long, None)]
    got = [r.s for r in spark.createDataFrame([(*p, k) for k, p in enumerate(pairs)], "t string, b string, k int").orderBy("k").select(shares_window(F.col("t"), F.col("b"), 50).alias("s")).collect()]
    assert [bool(s) for s in got] == [any(t[i:i + 50] in b for i in range(len(t) - 49)) if t and b else False for t, b in pairs]
    spark.createDataFrame([("c", long), ("d", long)], "chunk_id string, evidence string").write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([("c", "x" + long[40:90]), ("d", long[:30])], "id string, content string").write.parquet(f"{tmp_path}/document_chunks.parquet")
    assert [(r.id, r.n_copied) for r in activity.verbatim_copy(spark, str(tmp_path)).collect()] == [("c", 1)]


def test_every_question_is_answered(spark):
    docs = spark.createDataFrame([(n, f"common w{n}") for n in range(1500)], "doc_id int, text string")
    questions = spark.createDataFrame([(n, f"w{n}") for n in range(1500)], "query_id int, text string")
    assert {(r.query_id, r.doc_id) for r in lexical.bm25(docs, questions).collect()} == {(n, n) for n in range(1500)}


def test_third_round_and_topics_of_two(spark, tmp_path):
    rows = [(n, "a", "MENTIONS", f"x{n}") for n in range(3)] + [(10, "x0", "r", "y"), (11, "y", "r", "z"), (12, "z", "s", "end")]
    rows += [(20 + n, f"m{n}", "r", f"t{n // 2}") for n in range(10)]
    spark.createDataFrame(rows, "id int, subject string, predicate string, object string").write.parquet(f"{tmp_path}/edges.parquet")
    assert {r.node: r.round for r in plans.bfs_expand(spark, str(tmp_path)).collect()} == {"a": 0, "x0": 1, "x1": 1, "x2": 1, "y": 2, "z": 3}
    assert {r.rel: r.n for r in plans.induced_subgraph(spark, str(tmp_path)).collect()} == {"MENTIONS": 3, "r": 2}
    assert [(r.topic, r.members) for r in plans.shared_topics_fill(spark, str(tmp_path)).orderBy("place").collect()] == [(f"t{n}", 2) for n in range(5)]


def packed(text: str, size: int, overlap: int) -> list[str]:
    pieces, cur = [], ""
    for para in [p for p in re.split(r"\n\s*\n", text) if p.strip()]:
        joined = f"{cur}\n\n{para}" if cur else para
        if len(joined) <= size:
            cur = joined
            continue
        pieces += [cur] if cur else []
        while len(para) > size:
            pieces.append(para[:size])
            para = para[size - overlap:]
        cur = para
    return pieces + [cur] if cur else pieces


def test_long_paragraphs_are_cut(spark):
    rng = random.Random(4)
    texts = ["\n\n".join("".join(rng.choices("ab가", k=rng.choice([1, 5, 9, 10, 11, 13, 17, 18, 45, 60]))) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", "x" * 70]], "t string")
    for r in df.select("t", chunking.packed_paragraphs(F.col("t"), 10, 3).alias("p")).collect():
        assert r.p == packed(r.t, 10, 3) and all(len(p) <= 10 for p in r.p)


def test_lsh_finds_what_exact_search_finds(spark, data):
    exact = {(r.query_id, r.id) for r in search.knn_exact(spark, data).collect()}
    got = further.knn_lsh(spark, data).collect()
    assert {r.query_id for r in got} == {q for q, _ in exact} and max(r["rank"] for r in got) == 10
    assert len(exact & {(r.query_id, r.id) for r in got}) >= 0.9 * len(exact)
    print(len(exact & {(r.query_id, r.id) for r in got}), len(exact), len(got))


def test_bounds_of_verdicts_are_floats(spark, tmp_path):
    rows = [(n, "r", c) for n, c in enumerate([0.7, 0.7, 0.69, 0.4, 0.39, 0.0, 1.0, None, float("nan")])] + [(20, None, 0.7), (20, None, 0.7)]
    spark.createDataFrame(rows, "id int, extraction_run string, confidence float").write.parquet(f"{tmp_path}/edges.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW edges AS SELECT * FROM '{tmp_path}/edges.parquet/*.parquet'")
    expected = con.execute(details.SQL["verdict_score"]).fetchall()
    assert {tuple(r) for r in details.verdict_score(spark, str(tmp_path)).collect()} == set(expected) == {("r", 0.625, 0.25), (None, 1.0, 0.0)}


def test_paths_past_nodes_without_numbers(spark, tmp_path):
    ends = [("p50", "t1"), ("unknown", "t1"), ("p7", "t1"), ("p7", "lost"), ("p8", "lost"), ("p100", "unknown"), ("", "unknown"), ("p0", "t9"), ("p8", "t9"), ("p10", "t9"), ("p5", " "), (None, "t1"), ("p50", None)]
    spark.createDataFrame([(n, s, "USES", o) for n, (s, o) in enumerate(ends)], "id int, subject string, predicate string, object string").write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(i, "project", i) for i in ("p0", "p5", "p7", "p8", "p10", "p50", "p50", "p100", "p150")], "entity_id string, entity_type string, label string").write.parquet(f"{tmp_path}/entities.parquet")
    con = duckdb.connect()
    for t in ("edges", "entities"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    expected = con.execute(retrieval.SQL["project_paths"]).fetchall()
    got = [tuple(r) for r in retrieval.project_paths(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected) and {r[0] for r in got} == {"p0", "p50", "p100"} and {r[2] for r in got} == {1, 2}


def test_best_documents_of_many_queries(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices([f"w{int(k ** 1.5)}" for k in range(60)], [1 / (k + 1) for k in range(60)], k=n))
    texts = [None if n % 17 == 0 else "" if n % 19 == 0 else text(rng.randrange(1, 40)) for n in range(500)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts + texts[:200])], "doc_id bigint, text string").repartition(9)
    asked = [(n, t) for n, t in enumerate([text(rng.randrange(1, 9)) for _ in range(120)] + ["w0", "W0 w0", "nowhere", "nowhere w3", "", None, *[t for t in texts[:40]]])]
    queries = spark.createDataFrame([*asked, (7, "w1 w999")], "query_id int, text string")
    every = lambda df: sorted(tuple(r) for r in df.select("query_id", F.coalesce("doc_id", F.lit(-1)), "rank", F.round("score", 5)).collect())
    by_pairs = lambda docs: every(ranking.top_k(lexical.bm25(docs, queries), ["query_id"], [F.desc("score"), F.col("doc_id")], 4, "doc_id"))
    expected = by_pairs(docs)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        assert every(lexical.bm25_top(docs, queries, 4)) == expected
        again = docs.unionByName(spark.createDataFrame([(3, "w0 w1"), (3, texts[3]), (None, "w0")], "doc_id bigint, text string"))
        assert every(lexical.bm25_top(again, queries, 4)) == by_pairs(again)
        monkeypatch.setattr(lexical, "MOST_TERMS", 90)
        assert every(lexical.bm25_top(docs, queries, 4)) == expected
        none = docs.filter("false")
        assert every(lexical.bm25_top(none, queries, 4)) == every(lexical.bm25_top(docs, queries.filter("false"), 4)) == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_titles_are_answered_without_exchanging_pairs(spark, tmp_path):
    rows = [(50 * n, f"common w{n % 7} x{n}", "s", f"common w{n % 5}") for n in range(600)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, title string").write.parquet(f"{tmp_path}/documents.parquet")

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))

    before = written()
    assert search.bm25_titles(spark, str(tmp_path)).count() == 600 * 10
    assert written() - before < 600 * 600 / 5
