"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Queries or other rows of a block that is sent everywhere at a time.
BOUNDED_ROWS = 1024
#: Keys that may be dealt out over salts: what is sent everywhere for it stays below some 100 MB.
MOST_HOT = 1 << 20


def local_session(cores: int = 8, app: str = "quernlake") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that it needn't be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quernlake-")) / "quernlake.zip"  # Spark's file server hands it out
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of sessions that name none, by application.
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where it is unset and all
    runs on this machine. A cluster without a shared folder is an error: each executor would write its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _own.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='quernlake-')}"
        _own[app] = path
    return path


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: ends its lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows of a table that is small by definition; more than `most` are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """The keys of df with more than hot_rows rows and their `count`, or None where there is none."""
    return hot_counts(df.groupBy(*keys).count().filter(F.col("count") > hot_rows))


def hot_counts(counts: DataFrame) -> DataFrame | None:
    """Keys with their `count`, bounded for sending: all of them, or, where they are more than MOST_HOT,
    those above the least power of two that leaves no more. A key below it holds less than a 2**-19th
    of all rows then, so nothing that is left out is hot."""
    counts = cut(counts, "hot-keys")
    sizes = sorted(((int(r.b), r["count"]) for r in counts.groupBy(F.floor(F.log2("count")).alias("b")).count().collect()), reverse=True)
    if not sizes:
        return None
    kept, least = 0, sizes[0][0]
    for b, n in sizes:
        kept += n
        if kept > MOST_HOT:
            break
        least = b
    return counts if kept <= MOST_HOT else counts.filter(F.col("count") >= 2**least)


def with_salts(df: DataFrame, keys: list[str], hot: DataFrame | None, hot_rows: int, by: str | None) -> DataFrame:
    """Add column `salt`: rows of hot keys are dealt over count/hot_rows salts by a hash of column `by`,
    or copied to each salt where `by` is None; all other rows have salt 0."""
    if hot is None:
        return df.withColumn("salt", F.lit(0))
    sizes = hot.select(*keys, (F.floor(F.col("count") / hot_rows) + 1).cast("int").alias("n_salts"))
    joined = df.join(F.broadcast(sizes), keys, "left").withColumn("n_salts", F.coalesce("n_salts", F.lit(1)))
    if by is None:
        salted = joined.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)))
    else:
        salted = joined.withColumn("salt", F.pmod(F.xxhash64(by), F.col("n_salts")).cast("int"))
    return salted.drop("n_salts")
