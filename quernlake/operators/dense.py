"""Exact vector retrieval and vector checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.operators.ranking import top_k

#: Queries and rows that meet in one task.
BLOCK_QUERIES, BLOCK_ROWS = 1024, 16_384


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def vector_faults(v: Column, dimensions: int) -> Column:
    """null for a usable vector, else what is wrong: missing, dimension, not_finite, zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull(), "missing").when(F.size(v) != dimensions, "dimension").when(bad, "not_finite").when(F.forall(v, lambda x: x == 0), "zero")


def nearest(queries: DataFrame, data: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = True) -> DataFrame:
    """The k rows of data most alike to each query, exactly, by cosine or dot product.

    queries: query_id, vector. data: id, vector. Each block of BLOCK_QUERIES queries meets each block of
    BLOCK_ROWS rows in one task, so that neither side passes through the driver or is sent everywhere
    as a whole: n / BLOCK_ROWS copies of the queries and m / BLOCK_QUERIES of the data are exchanged.
    Null, short, long, zero and not finite vectors take no part; no rows give no rows.

    Result: query_id, id, score, rank.
    """
    sample = data.filter("vector is not null").select(F.size("vector").alias("s")).groupBy("s").count().orderBy(F.desc("count"), "s").first()
    width = sample.s if sample else 0
    fine = lambda df: df.filter(vector_faults(F.col("vector"), width).isNull())
    q, x = fine(queries.select("query_id", "vector")), fine(data.select("id", "vector"))
    q_blocks, x_blocks = max(1, -(-q.count() // BLOCK_QUERIES)), max(1, -(-x.count() // BLOCK_ROWS))
    null = F.lit(None)
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    shape = {"query_id": queries.schema["query_id"].dataType, "id": data.schema["id"].dataType}
    of_q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).select("qb", F.explode(every(x_blocks)).alias("xb"), "query_id", null.cast(shape["id"]).alias("id"), F.lit(True).alias("asks"), F.col("vector").cast("array<double>").alias("vector"))
    of_x = x.withColumn("xb", F.pmod(F.xxhash64("id"), F.lit(x_blocks))).select(F.explode(every(q_blocks)).alias("qb"), "xb", null.cast(shape["query_id"]).alias("query_id"), "id", F.lit(False).alias("asks"), F.col("vector").cast("array<double>").alias("vector"))

    def scan(group: pa.Table) -> pa.Table:
        asks = group.column("asks").combine_chunks()
        mine, theirs = group.filter(asks), group.filter(pc.invert(asks))
        ids, own = mine.column("query_id").combine_chunks(), theirs.column("id").combine_chunks()
        if not len(ids) or not len(own):
            return pa.table({"query_id": ids[:0], "id": own[:0], "score": pa.array([], pa.float64())})
        a, b = (np.asarray(t.column("vector").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (mine, theirs))
        if metric == "cosine":
            a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
        s = a @ b.T
        if exclude_self:
            at = {v: n for n, v in enumerate(own.to_pylist())}
            for n, v in enumerate(ids.to_pylist()):
                if v in at:
                    s[n, at[v]] = -np.inf
        m = min(k, s.shape[1])
        least = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        # All rows equal to the last kept one stay in, so that ties are settled by id.
        i, j = np.nonzero((s >= least[:, None] - 1e-9) & np.isfinite(s))
        return pa.table({"query_id": ids.take(pa.array(i)), "id": own.take(pa.array(j)), "score": pa.array(s[i, j])})

    schema = f"query_id {shape['query_id'].simpleString()}, id {shape['id'].simpleString()}, score double"
    parts = of_q.unionByName(of_x).groupBy("qb", "xb").applyInArrow(scan, schema)
    rounded = parts.withColumn("score", F.round("score", 6))
    return top_k(rounded, ["query_id"], [F.desc("score"), F.col("id")], k, "id")
