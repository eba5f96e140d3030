"""Gap detection and forward fills along a long order, without holding a key in one task.

Rows of a key are cut into buckets of their integer order; what crosses the edge of a bucket is one row
per bucket, so that a key with a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_BITS = 12


def with_group_starts(df: DataFrame, keys: list[str], order: str, starts, carry: list[str], bits: int = BUCKET_BITS) -> DataFrame:
    """Add `group_start`: the order of the row at which the row's group starts.

    starts(before) says whether a row starts a group; before gives, as columns, the values of `carry`
    in the row before it of the same key (null for the first). Order values of a key are distinct.
    """
    cut = df.withColumn("_bucket", F.shiftright(order, bits))
    inner = W.partitionBy(*keys, "_bucket").orderBy(order)
    outer = W.partitionBy(*keys).orderBy("_bucket")
    edge = cut.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*carry, order), order).alias("_last"))
    edge = edge.withColumn("_before", F.lag("_last").over(outer)).drop("_last")
    seen = cut.withColumn("_lag", F.lag(F.struct(*carry, order)).over(inner)).join(edge, [*keys, "_bucket"])
    seen = seen.withColumn("_prev", F.coalesce("_lag", "_before"))
    before = {c: F.col(f"_prev.{c}") for c in [*carry, order]}
    first = F.col("_prev").isNull() | F.coalesce(starts(before), F.lit(False))
    marked = seen.withColumn("_start", F.when(first, F.col(order))).drop("_lag", "_before", "_prev")
    filled = marked.withColumn("_in", F.last("_start", ignorenulls=True).over(inner.rowsBetween(W.unboundedPreceding, 0)))
    carried = marked.groupBy(*keys, "_bucket").agg(F.max("_start").alias("_s"))
    carried = carried.withColumn("_carried", F.last("_s", ignorenulls=True).over(outer.rowsBetween(W.unboundedPreceding, -1))).drop("_s")
    joined = filled.join(carried, [*keys, "_bucket"])
    return joined.withColumn("group_start", F.coalesce("_in", "_carried")).drop("_start", "_in", "_carried", "_bucket")


def last_before(df: DataFrame, keys: list[str], order: str, columns: list[str], bits: int = BUCKET_BITS) -> DataFrame:
    """Add `<column>_before` for each column: its last value that isn't null in the rows before of the
    same key, by buckets of the order, of which one row each meets the others of its key."""
    cut = df.withColumn("_bucket", F.shiftright(order, bits))
    inner = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "_bucket").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns))
    ends = ends.select(*keys, "_bucket", *(F.last(f"_{c}", ignorenulls=True).over(outer).alias(f"_{c}") for c in columns))
    seen = cut.select("*", *(F.last(c, ignorenulls=True).over(inner).alias(f"_in_{c}") for c in columns)).join(ends, [*keys, "_bucket"])
    return seen.select(*df.columns, *(F.coalesce(f"_in_{c}", f"_{c}").alias(f"{c}_before") for c in columns))


def gap_over(at: Column, before: Column, minutes: int) -> Column:
    """Whether a time is more than so many minutes after another; exactly as many are no gap."""
    return F.timestamp_diff("SECOND", before, at) > minutes * 60
