from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernlake.operators import chunking, graph, knowledge, ranking
from quernlake.operators.ordered import gap_over, with_group_starts
from quernlake.operators.references import orphan_references, orphan_report, split_key

T0 = datetime(2015, 1, 1)
REFS = "table_name string, field_name string, row_id string, target string, ref_key string, at timestamp, target_x string"
PARENTS = "target string, key string, loaded_at timestamp, deleted_at timestamp, extra int"


def brute_orphans(refs, parents):
    out = []
    for t, f, i, target, key, at, _ in refs:
        if key is None or not key.strip():
            continue
        rows = [p for p in parents if p[0] == target and p[1] == key]
        if not rows:
            out.append((t, f, i, "missing"))
        elif at is not None:
            loaded = [p for p in rows if p[2] is None or p[2] <= at]
            if not loaded:
                out.append((t, f, i, "not_loaded"))
            elif not any(p[3] is None or p[3] > at for p in loaded):
                out.append((t, f, i, "removed"))
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_orphans_like_brute_force(spark, hot_rows):
    rng = random.Random(5)
    keys = [f"e:{n:06d}" for n in range(60)] + [f"{n:024x}" for n in range(10**20, 10**20 + 20)] + ["x", "007", "7", "e:0", "9" * 25]
    parents = []
    for k in rng.sample(keys, 55):
        for _ in range(rng.choice([1, 1, 2])):
            a = T0 + timedelta(days=rng.randrange(20))
            parents.append((rng.choice(["a", "b"]), k, a, a + timedelta(days=rng.randrange(1, 9)) if rng.random() < 0.5 else None, 1))
    refs = [("t", "f", str(n), rng.choice(["a", "b"]), "e:000001" if n % 3 == 0 else rng.choice([*keys, None, " ", ""]), None if n % 11 == 0 else T0 + timedelta(days=rng.randrange(30)), "q") for n in range(300)]
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), hot_rows)
    assert sorted((r.table_name, r.field_name, r.row_id, r.reason) for r in got.collect()) == brute_orphans(refs, parents)


def test_orphans_of_empty_tables(spark):
    none_p, none_r = spark.createDataFrame([], PARENTS), spark.createDataFrame([], REFS)
    one = spark.createDataFrame([("t", "f", "1", "a", "k1", None, "q")] * 2, REFS)
    assert orphan_references(none_r, none_p).count() == 0
    assert [r.n_orphans for r in orphan_report(orphan_references(one, none_p)).collect()] == [1]


def test_keys_split_one_to_one(spark):
    keys = ["a1", "a01", "a001", "1", "01", "", "abc", "f" * 24, "0" * 24, "0" * 16, "12345678901234567890123", "é9", "a-9"]
    head, n = split_key(F.col("k"))
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", head.alias("h"), n.alias("n")).collect()
    assert len({(r.h, r.n) for r in rows}) == len(set(keys))


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_group_starts_across_buckets(spark, bits):
    rng = random.Random(bits)
    rows = []
    for room in range(3):
        at = T0
        for seq in sorted(rng.sample(range(200), 60)):
            at += timedelta(minutes=rng.choice([1, 29, 30, 31, 90]))
            rows.append((room, seq, at))
    expected, last = {}, {}
    for room, seq, at in rows:
        start = seq if room not in last or at - last[room][0] > timedelta(minutes=30) else last[room][1]
        expected[room, seq] = start
        last[room] = (at, start)
    df = spark.createDataFrame(rows, "room int, seq int, at timestamp")
    got = with_group_starts(df, ["room"], "seq", lambda b: gap_over(F.col("at"), b["at"], 30), ["at"], bits).collect()
    assert {(r.room, r.seq): r.group_start for r in got} == expected


def test_top_k_with_a_hot_key_and_ties(spark):
    df = spark.createDataFrame([("q", n, float(n % 3)) for n in range(500)], "query_id string, id int, score double")
    got = [r.id for r in ranking.top_k(df, ["query_id"], [F.desc("score"), F.col("id")], 5, "id", salts=7).orderBy("rank").collect()]
    assert got == [2, 5, 8, 11, 14]


def test_fusion_counts_a_repeated_document_once(spark):
    lists = spark.createDataFrame([("q", "a", 1, 9.0, 1), ("q", "a", 1, 8.0, 2), ("q", "b", 2, 1.0, 1), ("q", "b", 1, 0.5, 2)], "query_id string, method string, doc_id int, score double, rank int")
    rows = {r.doc_id: (round(r.score, 6), r.rank) for r in ranking.reciprocal_rank_fusion(lists).collect()}
    assert rows == {1: (round(1 / 61 + 1 / 62, 6), 1), 2: (round(1 / 61, 6), 2)}


def test_packing(spark):
    items = spark.createDataFrame([("q", n, n, size) for n, size in enumerate([40, 70, 50, 5], 1)], "query_id string, doc_id int, rank int, length int")
    cut = {r.doc_id: (r.kept, r.state) for r in ranking.pack_truncated(items, 100).collect()}
    assert cut == {1: (40, "whole"), 2: (60, "cut"), 3: (0, "out"), 4: (0, "out")}
    assert sorted(r.doc_id for r in ranking.pack_skipping(items, 100).collect()) == [1, 3, 4]


def test_graph(spark):
    e = spark.createDataFrame([(1, "a", "r", "b"), (2, "b", "r", "c"), (3, "c", "r", "a"), (4, "x", "r", "y"), (5, "z", "r", "z")], "edge_id bigint, src string, rel string, dst string")
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.end, r.hops) for r in graph.paths(e, start, 3).collect()} == {("b", 1), ("c", 2)}
    assert {(r.end, r.hops) for r in graph.paths(e, start, 3, unique="edge").collect()} == {("b", 1), ("c", 2), ("a", 3)}
    assert {(r.node, r.round) for r in graph.expand(e, start, 2).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    assert {(r.component, r.is_clique) for r in graph.cliques(pairs, graph.components(e)).collect()} == {("a", True), ("x", True)}


def test_upsert(spark):
    old, new = (spark.createDataFrame(r, "id int, v string") for r in ([(1, "a"), (2, "b")], [(2, "B"), (3, "C")]))
    assert sorted(map(tuple, knowledge.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, knowledge.upsert(old, new, ["id"], update=False).collect())) == [(1, "a"), (2, "b"), (3, "C")]


def test_packed_paragraphs(spark):
    text = "aaaa\n\nbb\n\n\ncccccccccc\n\nd"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = [r.p for r in df.select(chunking.packed_paragraphs(F.col("t"), 8).alias("p")).collect()]
    assert got[0] == ["aaaa\n\nbb", "cccccccccc", "d"] and not got[1]
