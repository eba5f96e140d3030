"""Plans that are guarded, memory by content, and commits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernlake.functions import commits
from quernlake.operators import dense, ranking
from quernlake.operators.ordered import last_before
from quernlake.operators.versions import Versions, remembered, table_hash


def test_plans_apply_once_and_only_to_what_they_are_for(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, x string")
    first = v.snapshot(df)
    assert first == table_hash(df.orderBy(F.desc("id"))) != table_hash(df.distinct())
    assert v.apply(df.filter("id = 1"), first, "p") == v.apply(df.filter("id = 1"), first, "p") == 1
    with pytest.raises(ValueError, match="made for"):
        v.apply(df, first, "q")
    with pytest.raises(ValueError, match="last change"):
        v.undo("q")
    assert v.undo("p") == v.undo("p") == 2
    assert sorted(map(tuple, v.read().collect())) == [(1, "a"), (2, "b"), (2, "b")]


def test_texts_are_computed_once(spark, tmp_path):
    path = str(tmp_path / "memo")
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id int, t string")
    count = lambda df: df.select("_key", F.size(F.split("t", " ")).alias("n"))
    for _ in range(2):
        assert {r.id: r.n for r in remembered(rows, "t", count, path).collect()} == {1: 2, 2: 2, 3: None, 4: 1}
    assert spark.read.parquet(path).count() == 2


def test_commits(spark):
    rows = [(["members/Ann/labs/a.py", "x.md"], "1+Zed@users.noreply.h.test", "Q"), (["x.md"], "12+Zed@users.noreply.h.test", "Q"), (["docs/a"], "bob@h.test", "Q"), ([".gitignore"], None, "Cy"), ([], "", None)]
    df = spark.createDataFrame(rows, "p array<string>, e string, a string")
    got = [tuple(r) for r in df.select(commits.commit_kind(F.col("p")), commits.commit_owner(F.col("p"), F.col("e"), F.col("a")), F.size(commits.working_files(F.col("p")))).collect()]
    assert got == [("lab", "ann", 2), ("note", "zed", 1), ("shared", "bob", 1), ("commit", "cy", 0), ("commit", None, 0)]


def test_numbers_over_ranges(spark):
    df = spark.range(5000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(97)))
    got = [r.id for r in ranking.numbered(df, [F.col("k"), F.desc("id")], "n").orderBy("n").collect()]
    assert got == [r.id for r in df.orderBy("k", F.desc("id")).collect()]
    assert ranking.numbered(df.limit(0), [F.col("id")], "n").count() == 0


def test_last_values_across_buckets(spark):
    rows = [(k % 2, k, None if k % 5 else k * 10) for k in range(0, 60)]
    df = spark.createDataFrame(rows, "r int, o int, v int")
    got = {(r.r, r.o): r.v_before for r in last_before(df, ["r"], "o", ["v"], bits=2).collect()}
    for r, o, _ in rows:
        seen = [v for a, b, v in rows if a == r and b < o and v is not None]
        assert got[r, o] == (seen[-1] if seen else None)


def test_unusable_vectors_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 3)
    rows = [(k, [1.0, float(k)]) for k in range(10)] + [(20, None), (21, [0.0, 0.0]), (22, [1.0]), (23, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    got = {}
    for r in dense.nearest(df.withColumnRenamed("id", "query_id"), df, 3, metric="dot").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    assert sorted(got) == list(range(10)) and sorted(got[9]) == [(1, 8), (2, 7), (3, 6)] and sorted(got[0])[0] == (1, 1)
    assert dense.nearest(df.limit(0).withColumnRenamed("id", "query_id"), df.limit(0), 3).count() == 0
