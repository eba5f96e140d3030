from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quernlake.functions import text as X


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_paths(spark):
    for given, expected in {"a/b/../c": "a/c", "../a/./b": "a/b", "a//b/": "a/b", "..": "", "": "", None: None}.items():
        assert one(spark, given, X.resolved_path) == expected


def test_clock(spark):
    for given, expected in {"오전 12:05": 5, "오후 12:05": 725, "오후 3:10": 910, "15:10": None, "": None}.items():
        assert one(spark, given, X.clock_12h) == expected


def test_timestamps(spark):
    assert one(spark, "2015-01-02 03:04:05", X.any_timestamp) == one(spark, "1420167845", X.any_timestamp) == datetime(2015, 1, 2, 3, 4, 5)
    assert one(spark, "no time", X.any_timestamp) is None


def test_patches_and_pull_requests(spark):
    patch = "+++ b/x\n+value = 1  # why\n-old\n+// note\n same"
    assert one(spark, patch, X.added_lines) == ["value = 1"]
    assert one(spark, "https://host.test/Own-Er/Repo-A/pull/12/files", X.pull_request) == "own_er/repo_a#12"
    assert one(spark, "https://host.test/x", X.pull_request) is None


def test_masks_work_in_order(spark):
    df = spark.createDataFrame([("a@b.co 010-1234-5678 1234567890123번 900101-1234567",)], "x string")
    text, counts = X.masked(F.col("x"))
    row = df.select(text.alias("t"), *(c.alias(k) for k, c in counts.items())).first()
    assert row.t == "[email] [mobile] [number]번 [resident]"
    assert (row.email, row.mobile, row.number, row.resident, row.card) == (1, 1, 1, 1, 0)


def test_markdown_and_tags(spark):
    assert one(spark, "# T\n\n- a [b](c)\n> q ![i](u)\n```py\nx\n```", X.clean_markdown) == "T\n\na b\nq \n\nx\n"
    assert one(spark, "#A, a ,,b", lambda c: X.normalised_tags(F.split(c, ","))) == ["a", "b"]
    assert one(spark, "[x](u/v) [[w|z]] [y](u/v)", X.links) == ["u/v", "w"]
    assert one(spark, "1.5", X.clean_number) == 1.5 and one(spark, "-1", X.clean_number) is None and one(spark, "x", X.clean_number) is None
