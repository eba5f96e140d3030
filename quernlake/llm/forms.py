"""Duplicates hidden by formatting: rows that are the same but for their form, collapsed and counted.

Byte-identical rows collapse first, with counts; only the distinct survivors are canonicalised; the
survivors are grouped again on their full canonical text and the counts summed.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.session import cut, hot_counts, hot_keys, table, with_salts

HOT_ROWS = 1_000_000
#: Texts of these characters alone have no other width, composition or invisible characters.
_PLAIN = r"^[\t\n\r\x20-\x7E가-힣]*$"
#: A text that may be made of fields.
_FIELDED = r"^\s*(\{|---|[\w ]+:)"
_VISIBLE = r"[^\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"

_INVISIBLE = regex.compile(r"[\p{Cc}\p{Cf}\p{Default_Ignorable_Code_Point}⠀]+")
_BLANKS = regex.compile(r"[\s\p{Z}]+")
_DROPPED = regex.compile(r"[\s\p{Z}\p{C}\p{P}\p{Default_Ignorable_Code_Point}⠀]+")
_KEY = regex.compile(r"(?<![\w])([\p{L}_][\p{L}\p{N}_]*+)\s*:(?!/)")


def visible(text: Column) -> Column:
    """Whether a text holds anything visible; null for null."""
    return text.rlike(_VISIBLE)


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def _flat(value: object) -> str:
    if isinstance(value, dict):
        return "\x1e".join(sorted(f"{_DROPPED.sub('', _fold(str(k)))}\x1d{_flat(v)}" for k, v in value.items()))
    if isinstance(value, list):
        return "\x1f".join(map(_flat, value))
    return _DROPPED.sub("", _fold(json.dumps(value) if not isinstance(value, str) else value))


def canonical_fields(folded: str) -> str | None:
    """The fields of a folded text in a fixed order, or None if it isn't made of fields."""
    spaced = _BLANKS.sub(" ", _INVISIBLE.sub(lambda m: " " if m[0].isspace() else "", folded)).strip()
    if spaced.startswith("{"):
        try:
            value = json.loads(spaced)
            if isinstance(value, dict) and value:
                return _flat(value)
        except (ValueError, RecursionError):  # not JSON, or nested too deep to be fields
            pass
        spaced = regex.sub(r"[\"'{}]+", " ", spaced).strip(" ,")
    body = spaced.strip("- ")
    marks = list(_KEY.finditer(body))
    if len(marks) < 2 or marks[0].start() > 0:
        return None
    ends = [m.start() for m in marks[1:]] + [len(body)]
    return "\x1e".join(sorted(f"{_DROPPED.sub('', m[1])}\x1d{_DROPPED.sub('', body[m.end():e])}" for m, e in zip(marks, ends, strict=True)))


def canonical_text(text: str, fields: bool = False) -> str:
    """What is left of a text without its form: no whitespace, invisible characters, punctuation or
    letter case, one Unicode width and composition and, with `fields`, one order of its fields."""
    folded = _fold(text)
    return (canonical_fields(folded) if fields else None) or _DROPPED.sub("", folded)


def canonical(text: Column, fields: Column) -> Column:
    """canonical_text as a column; plain texts stay in the JVM."""

    @F.pandas_udf("string")
    def by_hand(texts: pd.Series, fielded: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else canonical_text(t, bool(f)) for t, f in zip(texts, fielded, strict=True)], dtype=object)

    plain = text.rlike(_PLAIN) & ~(fields & text.rlike(_FIELDED))
    quick = F.regexp_replace(F.lower(text), r"[^a-z0-9가-힣$+<=>^`|~]", "")
    return F.when(plain, quick).otherwise(by_hand(F.when(~plain, text), fields))


def copy_classes(rows: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Classes of rows that are the same but for their form.

    rows: table_name, row_id (string), text, fields (whether the order of fields is form). Null texts
    and texts without anything visible belong to no class; texts of punctuation alone are all form: they
    are counted in one class, and as nothing is left of them to compare, none is said to be another's copy. A row delivered again counts as a further copy; ids are compared as text; very long texts
    are compared whole. Extra columns are ignored and an empty table gives no class.

    Result: (classes, membership). classes: table_name, row_id (the smallest id), n_copies, n_forms.
    membership: table_name, row_id, class_id, a row for each row of a class with more than one copy.
    """
    given = rows.select("table_name", "row_id", "text", "fields").filter(visible(F.col("text")))
    raw = given.groupBy("table_name", "fields", "text").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"))
    survivors = cut(
        raw.select("table_name", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("form"), canonical(F.col("text"), F.col("fields")).alias("whole"), "n", "row_id"),
        "forms",
    )
    grouped = survivors.groupBy("table_name", "whole").agg(
        F.sum("n").alias("n_copies"), F.count("*").alias("n_forms"), F.min("row_id").alias("row_id")
    )
    classes = grouped.select("table_name", "row_id", "n_copies", "n_forms")
    several = grouped.filter("n_copies > 1 and whole <> ''").select("table_name", F.sha2("whole", 256).alias("key"), F.col("row_id").alias("class_id"))
    forms = survivors.select("table_name", "form", F.sha2("whole", 256).alias("key"))
    hot = hot_keys(forms, ["table_name", "key"], hot_rows)
    keys = ["table_name", "key", "salt"]
    of_form = with_salts(forms, keys[:2], hot, hot_rows, "form").join(with_salts(several, keys[:2], hot, hot_rows, None), keys)
    ids = given.select("table_name", "row_id", F.sha2("text", 256).alias("form"))
    hot = hot_counts(survivors.filter(F.col("n") > hot_rows).select("table_name", "form", F.col("n").alias("count")))
    keys = ["table_name", "form", "salt"]
    membership = with_salts(ids, keys[:2], hot, hot_rows, "row_id").join(
        with_salts(of_form.select("table_name", "form", "class_id"), keys[:2], hot, hot_rows, None), keys
    )
    return classes, membership.select("table_name", "row_id", "class_id")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, text: str, fields: bool) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("table_name"), F.col("id").cast("string").alias("row_id"), F.col(text).alias("text"), F.lit(fields).alias("fields")
        )

    return of("chunks", "text", False).unionByName(of("document_chunks", "content", True))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, membership = copy_classes(_rows(spark, sf_dir))
    pairs = membership.filter("row_id <> class_id").distinct()
    return pairs.select("table_name", F.col("class_id").alias("id_a"), F.col("row_id").alias("id_b"))


def p6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = copy_classes(_rows(spark, sf_dir))
    return classes


QUERIES = {"p6_found": p6_found, "p6_copies": p6_copies}
SQL: dict[str, str] = {}
