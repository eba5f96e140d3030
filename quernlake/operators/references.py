"""References to records that do not exist.

Keys are split into a head and an integer, the parents' integers are compressed into contiguous runs,
and every reference is matched as of the preceding run start: it is missing where its integer lies
beyond that run's end. References inside a run are then held against the periods of presence of
exactly their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernlake.session import hot_keys, with_salts

#: Integers per bucket, as a power of two. Runs end at bucket ends, so buckets are matched apart.
BUCKET_BITS = 12
#: References of one bucket beyond which the bucket is salted.
HOT_ROWS = 1_000_000
_NEVER = -(2**62)
_OPEN = 2**62


def split_key(key: Column) -> tuple[Column, Column]:
    """A key as (head, integer), one to one: no two different keys have the same pair.

    Long lower-case hexadecimal keys give their last 15 digits, others their last 1 to 18 decimal
    digits; the digits' number is part of the head, so leading zeros count. A key without digits is
    its own head with integer 0.
    """
    is_hex = key.rlike("^[0-9a-f]{16,}$")
    digits = F.regexp_extract(key, "([0-9]{1,18})$", 1)
    width = F.length(digits)
    head = F.when(is_hex, F.concat(F.lit("x:"), F.substring(key, F.lit(1), F.length(key) - 15))).otherwise(
        F.concat(width.cast("string"), F.lit(":"), F.substring(key, F.lit(1), F.length(key) - width))
    )
    number = F.when(is_hex, F.conv(F.right(key, F.lit(15)), 16, 10).cast("bigint")).otherwise(
        F.when(width > 0, digits.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    )
    return head, number


def _keyed(df: DataFrame, key: str) -> DataFrame:
    head, number = split_key(F.col(key))
    return (
        df.withColumn("head", F.concat_ws("|", "target", head))
        .withColumn("n", number)
        .withColumn("bucket", F.shiftright("n", BUCKET_BITS))
    )


def key_runs(keys: DataFrame) -> DataFrame:
    """Distinct (head, bucket, n) as contiguous runs (head, bucket, run_start, run_end)."""
    w = W.partitionBy("head", "bucket").orderBy("n")
    starts = F.when(F.coalesce(F.col("n") != F.lag("n").over(w) + 1, F.lit(True)), F.col("n"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return (
        keys.withColumn("_s", starts)
        .withColumn("run_start", F.last("_s", ignorenulls=True).over(upto))
        .groupBy("head", "bucket", "run_start")
        .agg(F.max("n").alias("run_end"))
    )


def orphan_references(references: DataFrame, parents: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The references whose key is absent, removed or not yet loaded.

    references: table_name, field_name, row_id (strings), target, ref_key, at (timestamp or null).
    parents: target, key, loaded_at, deleted_at. A parent is present from loaded_at (included) to
    deleted_at (excluded, open if null); with a null loaded_at it is always there until deleted_at.

    Result: table_name, field_name, row_id, at, reason (missing, removed, not_loaded), a row for each
    delivered row. Null and whitespace-only keys are no references; keys are compared exactly as
    stored; with a null `at` only missing keys count; empty inputs give an empty result or, without
    parents, every reference as missing. Repeated rows give repeated results. Extra columns are ignored.
    """
    refs = _keyed(
        references.select("table_name", "field_name", "row_id", "target", "ref_key", "at").filter(
            F.col("ref_key").rlike(r"[^\s\p{Z}]")
        ),
        "ref_key",
    )
    known = _keyed(parents.select("target", "key", "loaded_at", "deleted_at").filter("key is not null"), "key")
    hot = hot_keys(refs, ["head", "bucket"], hot_rows)

    null = F.lit(None)
    shape = {
        "head": "string", "bucket": "bigint", "n": "bigint", "ts": "bigint", "ord": "int",
        "run_end": "bigint", "until": "bigint", "table_name": "string", "field_name": "string",
        "row_id": "string", "at": "timestamp", "salt": "int",
    }

    def shaped(df: DataFrame, **cols: Column) -> DataFrame:
        return df.select(*(cols.get(c, F.col(c) if c in df.columns else null).cast(t).alias(c) for c, t in shape.items()))

    keys = ["head", "bucket"]
    runs = key_runs(known.select("head", "bucket", "n").distinct())
    run_rows = shaped(
        with_salts(runs, keys, hot, hot_rows, None), n=F.col("run_start"), ts=F.lit(_NEVER - 1), ord=F.lit(0)
    )
    present_rows = shaped(
        with_salts(known.distinct(), keys, hot, hot_rows, None),
        ts=F.coalesce(F.unix_micros("loaded_at"), F.lit(_NEVER)),
        until=F.coalesce(F.unix_micros("deleted_at"), F.lit(_OPEN)),
        ord=F.lit(1),
    )
    ref_rows = shaped(
        with_salts(refs, keys, hot, hot_rows, "row_id"), ts=F.coalesce(F.unix_micros("at"), F.lit(_OPEN)), ord=F.lit(2)
    )
    by_key = W.partitionBy("head", "bucket", "salt").orderBy("n", "ts", "ord")
    by_time = W.partitionBy("head", "bucket", "salt", "n").orderBy("ts", "ord")
    upto = (W.unboundedPreceding, 0)
    missing = F.coalesce(F.col("n") > F.col("asof_end"), F.lit(True))
    reason = (
        F.when(missing, "missing")
        .when(F.col("at").isNull() | (F.col("seen_until") > F.col("ts")), null)
        .when(F.col("seen_until").isNull(), "not_loaded")
        .otherwise("removed")
    )
    return (
        run_rows.unionByName(present_rows)
        .unionByName(ref_rows)
        .withColumn("asof_end", F.last("run_end", ignorenulls=True).over(by_key.rowsBetween(*upto)))
        .withColumn("seen_until", F.max("until").over(by_time.rowsBetween(*upto)))
        .filter("ord = 2")
        .withColumn("reason", reason)
        .filter("reason is not null")
        .select("table_name", "field_name", "row_id", "at", "reason")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, month of `at` (null where unknown) and reason, each id once."""
    once = orphans.groupBy("table_name", "field_name", "row_id").agg(F.min(F.struct("at", "reason")).alias("o"))
    return (
        once.groupBy("table_name", "field_name", F.date_format("o.at", "yyyy-MM").alias("month"), F.col("o.reason").alias("reason"))
        .agg(F.count("*").alias("n_orphans"))
    )
