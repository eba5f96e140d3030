from __future__ import annotations

import subprocess

import pytest

from quernlake.sources import files
from quernlake.sources.gitlog import GitLogSource


def test_jsonl_tolerant_and_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "t": "x y"}\n\nnot json\n{"a": 2}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(tmp_path), "a int, t string").collect()
    assert sorted(r.a for r in rows if r.a) == [1, 2] and any(r.t == "x y" for r in rows)
    assert [r._corrupt_record for r in rows if r._corrupt_record] == ["not json"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path), "a int, t string", strict=True).collect()


def test_repeated_keys(spark):
    lines = spark.createDataFrame([('{"a": 1, "a": 2}',), ('{"a": 1}',), ("x",), (None,)], "value string")
    assert [(r["keys"]) for r in files.repeated_keys(lines).collect()] == [["a"]]


def test_chat_csv_goes_on_over_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('DATE,User,Message\n2024-01-01,kim,"one\ntwo"\n,,three\n2024-01-02,lee,four\n', encoding="utf-8")
    rows = sorted((r.sender, r.message) for r in files.read_chat_csv(spark, str(tmp_path)).collect())
    assert rows == [("kim", "one\ntwo\nthree"), ("lee", "four")]


def test_text_by_encoding(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("가나".encode())
    (tmp_path / "k.txt").write_bytes("가나".encode("cp949"))
    assert sorted((r.encoding, r.text) for r in files.read_text(spark, str(tmp_path)).collect()) == [("cp949", "가나"), ("utf-8-sig", "가나")]


def test_tree(spark, tmp_path):
    (tmp_path / "a" / "b c").mkdir(parents=True)
    (tmp_path / "a" / "b c" / "x.md").write_text("# x")
    (tmp_path / "y.md").write_text("y")
    (tmp_path / "z.txt").write_text("z")
    rows = sorted((r.path, r.folder, r.name, r.text) for r in files.read_tree(spark, str(tmp_path)).collect())
    assert rows == [("a/b c/x.md", "a/b c", "x.md", "# x"), ("y.md", "", "y.md", "y")]


def test_tsv(spark, tmp_path):
    files.write_tsv(spark.createDataFrame([(1, "a\nb")], "i int, t string"), str(tmp_path / "o"))
    lines = {x for p in (tmp_path / "o").glob("part*") for x in p.read_text().splitlines()}
    assert lines == {"i\tt", "1\ta\\nb"}


def test_git_log(spark, tmp_path):
    def git(*a):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y.test", *a], check=True, capture_output=True)

    git("init", "-q")
    for n in range(3):
        (tmp_path / f"f{n}.txt").write_text("a\nb\n")
        git("add", "-A")
        git("commit", "-qm", f"change {n}")
    spark.dataSource.register(GitLogSource)
    rows = spark.read.format("gitlog").option("path", str(tmp_path)).option("partitions", 2).load().collect()
    assert sorted((r.message, r.path, r.added) for r in rows) == [(f"change {n}", f"f{n}.txt", 2) for n in range(3)]
