"""Activity analytics over events (member, day or time, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily(events: DataFrame) -> DataFrame:
    """member, day, n: what all calendars start from; one row a member and day is all that is shuffled."""
    return events.groupBy("member", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def heatmap(days: DataFrame, length: int) -> DataFrame:
    """The last `length` days of each member, with zeros where nothing was: member, day, n."""
    last = days.agg(F.max("day").alias("d")).first().d
    if last is None:
        return days
    end = F.lit(last)
    grid = days.select("member").distinct().select("member", F.explode(F.sequence(F.date_sub(end, length - 1), end)).alias("day"))
    return grid.join(days, ["member", "day"], "left").na.fill(0, ["n"])


def streaks(days: DataFrame) -> DataFrame:
    """Islands of successive days: member, first_day, last_day, length."""
    rank = F.row_number().over(W.partitionBy("member").orderBy("day"))
    island = days.withColumn("_i", F.date_sub("day", rank))
    return island.groupBy("member", "_i").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("length")).drop("_i")


def current_streaks(islands: DataFrame, today: Column) -> DataFrame:
    """The streak that ends today or yesterday, else 0."""
    live = F.max(F.when(F.col("last_day") >= F.date_sub(today, 1), F.col("length")))
    return islands.groupBy("member").agg(F.coalesce(live, F.lit(0).cast("bigint")).alias("current"), F.max("length").alias("longest"))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)


def _from(times: Column, since: Column) -> Column:
    return F.filter(times, lambda t: t >= since)


def funnel(events: DataFrame, steps: list[str]) -> DataFrame:
    """Members who reach each step after all steps before it: step, n. Each step is the first time at or
    after the step before, found from the sorted times of a member's kind without joining events."""
    times = events.filter(F.col("kind").isin(steps)).groupBy("member").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == s, F.col("ts")))).alias(s) for s in steps))
    at, out = None, times
    for k, s in enumerate(steps):
        later = F.col(s) if at is None else _from(F.col(s), F.col(at))
        out = out.withColumn(f"_t{k}", F.get(later, F.lit(0)))
        at = f"_t{k}"
    counted = out.agg(*(F.count(f"_t{k}").alias(s) for k, s in enumerate(steps)))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(s).alias("kind"), F.col(s).alias("n")) for k, s in enumerate(steps)))))


def stratified_sample(df: DataFrame, strata: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows a stratum in the order of a hash, so that the same rows come out anywhere."""
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    part = hashed.withColumn("_s", F.substring("_h", 1, 2))
    part = part.withColumn("_r", F.row_number().over(W.partitionBy(strata, "_s").orderBy("_h", key))).filter(F.col("_r") <= n)
    return part.withColumn("_r", F.row_number().over(W.partitionBy(strata).orderBy("_h", key))).filter(F.col("_r") <= n).drop("_h", "_s", "_r")
