"""Tables that change by plan: a change is applied only to what it was planned for, and can be undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_hash(df: DataFrame) -> str:
    """A hash of a table's rows in any order, copies counted: two sums of hashes and the number of rows."""
    names = sorted(df.columns)
    a, b = F.xxhash64(F.lit(1), *names), F.xxhash64(F.lit(2), *names)
    r = df.agg(F.count("*").alias("n"), F.sum(a.cast("decimal(38,0)")).alias("a"), F.sum(b.cast("decimal(38,0)")).alias("b")).first()
    return f"{r.n}:{r.a or 0}:{r.b or 0}"


class Versions:
    """A table kept as numbered folders below a path; each names the hash of what it was made from."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _notes(self) -> list:
        try:
            return self.spark.read.json(f"{self.path}/notes").orderBy("version").collect()
        except Exception:  # noqa: BLE001 - nothing is there yet
            return []

    def _write(self, df: DataFrame, before: str, plan: str) -> int:
        version = len(self._notes())
        df.write.mode("overwrite").parquet(f"{self.path}/{version:06d}")
        after = table_hash(self.read(version))
        note = [(version, before, after, plan)]
        self.spark.createDataFrame(note, "version int, before string, after string, plan string").coalesce(1).write.mode("append").json(f"{self.path}/notes")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        version = self._notes()[-1].version if version is None else version
        return self.spark.read.parquet(f"{self.path}/{version:06d}")

    def snapshot(self, df: DataFrame) -> str:
        """The first version; its hash."""
        self._write(df, "", "snapshot")
        return self._notes()[-1].after

    def apply(self, changed: DataFrame, planned_for: str, plan: str) -> int:
        """Make `changed` the newest version if the table is still what the plan was made for. A plan
        that has been applied already changes nothing."""
        notes = self._notes()
        if notes[-1].plan == plan and notes[-1].before == planned_for:
            return notes[-1].version
        if notes[-1].after != planned_for:
            raise ValueError("the table is not what the plan was made for")
        return self._write(changed, planned_for, plan)

    def undo(self, plan: str) -> int:
        """The version before a plan again, if nothing has changed since; undone twice is undone once."""
        notes = self._notes()
        if notes[-1].plan == f"undo {plan}":
            return notes[-1].version
        if notes[-1].plan != plan:
            raise ValueError("the plan isn't the last change")
        return self._write(self.read(notes[-1].version - 1), notes[-1].after, f"undo {plan}")


def remembered(rows: DataFrame, text: str, compute, path: str) -> DataFrame:
    """compute(rows) for texts that aren't in the memory at path yet, each once by the hash of its text;
    the memory takes the results (key and compute's columns) and answers for all rows."""
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", F.sha2(F.col(text), 256))
    fresh = keyed.filter(F.col(text).isNotNull()).groupBy("_key").agg(F.first(text).alias(text))
    try:
        fresh = fresh.join(spark.read.parquet(path).select("_key"), "_key", "left_anti")
    except Exception:  # noqa: BLE001 - the memory is empty
        pass
    compute(fresh).write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path).drop(text), "_key", "left").drop("_key")
