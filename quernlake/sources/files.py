"""File sources and sinks: JSONL, CSV, text trees, snapshots and triples."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines with a declared schema; lines end at newlines only, so U+2028 may stand in strings.

    Tolerant: blank lines are passed over, and a broken line gives nulls and itself in _corrupt_record.
    Strict: a broken line fails the job when it is read.
    """
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("lineSep", "\n")
    if strict:
        return reader.option("mode", "FAILFAST").schema(declared).json(path)
    return reader.option("columnNameOfCorruptRecord", "_corrupt_record").schema(declared.add("_corrupt_record", "string") if "_corrupt_record" not in declared.names else declared).json(path)


def repeated_keys(lines: DataFrame) -> DataFrame:
    """Lines (value) of JSON objects in which a key stands twice, with those keys."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for line in batch["value"]:
                twice: list[str] = []

                def pairs(items: list, twice: list[str] = twice) -> dict:
                    seen: set[str] = set()
                    for k, _ in items:
                        if k in seen:
                            twice.append(k)
                        seen.add(k)
                    return dict(items)

                try:
                    json.loads(line or "{}", object_pairs_hook=pairs)
                except ValueError:
                    continue
                if twice:
                    rows.append((line, sorted(set(twice))))
            yield pd.DataFrame(rows, columns=["value", "keys"])

    return lines.select("value").mapInPandas(check, "value string, keys array<string>")


def write_jsonl(df: DataFrame, path: str, exclusive: bool = False) -> None:
    """JSON lines; the commit is atomic, and `exclusive` fails where something is already."""
    df.write.mode("errorifexists" if exclusive else "overwrite").json(path)


def read_json_document(spark: SparkSession, path: str, schema: str, inner: str) -> DataFrame:
    """The elements of the array `inner` of whole-file JSON documents."""
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline(inner))


def read_chat_csv(spark: SparkSession, path: str) -> DataFrame:
    """A chat export with columns Date, User and Message in any case: file, line, sent, sender, message.

    A row with neither date nor user goes on with the message before it. Files are exports of one
    room each, so that the order inside a file is all that is needed.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.lower().strip("﻿ "): c for c in raw.columns}
    rows = raw.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), *(F.col(f"`{names[c]}`").alias(c) for c in ("date", "user", "message")))
    blank = (F.coalesce(F.trim("date"), F.lit("")) == "") & (F.coalesce(F.trim("user"), F.lit("")) == "")
    w = W.partitionBy("file").orderBy("line")
    start = F.max(F.when(~blank, F.col("line"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    parts = rows.withColumn("start", start).groupBy("file", "start").agg(F.min_by(F.struct("date", "user"), "line").alias("h"), F.array_sort(F.collect_list(F.struct("line", "message"))).alias("m"))
    return parts.select("file", F.col("start").alias("line"), F.col("h.date").alias("sent"), F.col("h.user").alias("sender"), F.array_join(F.transform("m", lambda x: x["message"]), "\n").alias("message"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated values; line ends inside values become \\n."""
    flat = [F.regexp_replace(F.col(c).cast("string"), r"\r?\n", r"\\n").alias(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def read_text(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8-sig", "utf-8", "cp949")) -> DataFrame:
    """Whole text files by the first encoding that fits: path, encoding, text (null where none does)."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = (name, None, None)
                for e in encodings:
                    try:
                        found = (name, e, bytes(content).decode(e))
                        break
                    except UnicodeDecodeError:
                        continue
                rows.append(found)
            yield pd.DataFrame(rows, columns=["path", "encoding", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, encoding string, text string")


def read_tree(spark: SparkSession, root: str, pattern: str = "*.md", excluded: str | None = None) -> DataFrame:
    """Files below a folder as rows: path (below the root), folder, name, text; those whose path
    matches `excluded` are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = root.rstrip("/") + "/"
    below = F.substring(full, F.locate(folder, full) + len(folder), F.length(full))
    rows = files.select(below.alias("path"), F.col("value").alias("text"))
    rows = rows.filter(~F.col("path").rlike(excluded)) if excluded else rows
    return rows.select("path", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("folder"), F.substring_index("path", "/", -1).alias("name"), "text")


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str, drop: tuple[str, ...] = ("embedding",)) -> None:
    """Nodes and edges as compressed JSON lines, without heavy properties; nodes by type."""
    nodes.drop(*drop).write.mode("overwrite").partitionBy("type").option("compression", "gzip").json(f"{path}/nodes")
    edges.drop(*drop).write.mode("overwrite").option("compression", "gzip").json(f"{path}/edges")


def turtle(s: Column, p: Column, o: Column, literal: Column) -> Column:
    """A triple as a Turtle line; literals are escaped."""
    text = F.replace(F.replace(F.replace(o, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), F.when(literal, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("<"), o, F.lit(">"))), F.lit(" ."))


def json_ld(triples: DataFrame) -> DataFrame:
    """A JSON object per subject of triples (s, p, o), its values gathered by predicate."""
    by = triples.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("o"))
    return by.groupBy("s").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o"))))).alias("node"))


def public_columns(df: DataFrame) -> DataFrame:
    """Without the columns whose names start with an underscore."""
    return df.select(*(c for c in df.columns if not c.startswith("_")))
