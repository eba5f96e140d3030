"""Most similar vectors for every vector, by score-aware quantisation and exact reranking.

Unit vectors are dealt to the cells of their nearest centroids, each to a few, so that near vectors
share one. Inside a cell the residuals are quantised to four bits a subspace with a loss that weighs
the error along the vector more than across it, since that is what an inner product sees; tables of
the query's products with the codes are scanned, and the best candidates are ranked by their exact
cosine. Equal vectors are one until the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernlake.session import table

DIMENSIONS = 64
#: Vectors of one cell on the average, cells of one vector, and the most cells of a part: their centroids
#: are what is sent everywhere (64 MB at most a part; cells of more than 10^9 rows a part are larger).
CELL_ROWS, SPILL, MOST_CELLS = 4000, 3, 262_144
#: Rows, by a hash of the id, that the driver fits a part's coarse centroids and codebooks on, and coarse
#: centroids at most. Where a part needs more cells, each coarse one is parted in Spark, on about
#: CELL_SAMPLE rows a cell, and a vector is tried against the cells of its nearest COARSE_NEAR.
SAMPLE_ROWS, COARSE, CELL_SAMPLE, COARSE_NEAR = 8192, 256, 32, 8
#: Rows of a task of the search, on the average.
TASK_ROWS = 16_384
#: Estimated rows of a cell beyond which it is worked off in blocks.
BLOCK_ROWS = 40_000
SUBSPACES, CODES = 16, 16
#: Cosine from which scores matter; it sets the weight of the parallel error.
SCORE_FROM = 0.2
#: Candidates that the table scan hands to the exact ranking, per query and cell, for k neighbours.
RERANK = 5


class Index(NamedTuple):
    centroids: np.ndarray  # (cells, d)
    books: np.ndarray  # (subspaces, codes, d / subspaces)
    blocks: np.ndarray  # (cells,) blocks a cell is worked off in
    coarse: np.ndarray  # (coarse cells, d)
    firsts: np.ndarray  # (coarse cells + 1,) where the cells of a coarse one start; empty with one level

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The nearest cells of each vector, -1 where there are fewer."""
        if not len(self.firsts):
            return np.argsort(-(x @ self.centroids.T), axis=1)[:, : min(SPILL, len(self.centroids))]
        near = np.argsort(-(x @ self.coarse.T), axis=1)[:, :COARSE_NEAR]
        best, score = np.full((len(x), SPILL), -1), np.full((len(x), SPILL), -np.inf)
        for c in np.unique(near):
            at = np.flatnonzero((near == c).any(1))
            lo, hi = self.firsts[c], self.firsts[c + 1]
            if lo == hi:
                continue
            all_scores = np.concatenate([score[at], x[at] @ self.centroids[lo:hi].T], axis=1)
            all_cells = np.concatenate([best[at], np.broadcast_to(np.arange(lo, hi), (len(at), hi - lo))], axis=1)
            top = np.argsort(-all_scores, axis=1)[:, :SPILL]
            best[at], score[at] = np.take_along_axis(all_cells, top, 1), np.take_along_axis(all_scores, top, 1)
        return best


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def fit_centroids(x: np.ndarray, cells: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centroids by halving the largest cell along its direction of most spread, then by rounds of means."""
    groups = [np.arange(len(x))]
    while len(groups) < cells:
        k = max(range(len(groups)), key=lambda g: len(groups[g]))
        rows = groups.pop(k)
        if len(rows) < 2:
            groups.append(rows)
            break
        y = x[rows] - x[rows].mean(0)
        v = rng.standard_normal(x.shape[1]).astype(x.dtype)
        for _ in range(6):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-30
        order = np.argsort(y @ v, kind="stable")
        groups += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2:]]]
    c = _unit(np.stack([x[g].mean(0) for g in groups]))
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        filled = np.bincount(near, minlength=len(c)) > 0
        c[filled] = _unit(sums[filled])
    return c


def eta(dimensions: int, score: float = SCORE_FROM) -> float:
    """Weight of the parallel against the orthogonal error."""
    return max(1.0, (dimensions - 1) * score**2 / (1 - score**2))


def encode(x: np.ndarray, residual: np.ndarray, books: np.ndarray, weight: float, passes: int = 1) -> np.ndarray:
    """Codes (n, subspaces) of residuals: nearest codes first, then subspace by subspace the code of
    least anisotropic loss |e|^2 + (weight - 1) (e . x)^2."""
    m, c, w = books.shape
    xs, rs = x.reshape(len(x), m, w), residual.reshape(len(x), m, w)
    square = (books**2).sum(2)
    codes = np.stack([(square[j] - 2 * rs[:, j] @ books[j].T).argmin(1) for j in range(m)], axis=1)
    along = np.stack([((rs[:, j] - books[j][codes[:, j]]) * xs[:, j]).sum(1) for j in range(m)], axis=1)
    total = along.sum(1)
    for _ in range(passes):
        for j in range(m):
            rest = total - along[:, j]
            each = (rs[:, j] * xs[:, j]).sum(1)[:, None] - xs[:, j] @ books[j].T
            loss = square[j] - 2 * rs[:, j] @ books[j].T + (weight - 1) * (rest[:, None] + each) ** 2
            codes[:, j] = loss.argmin(1)
            along[:, j] = each[np.arange(len(x)), codes[:, j]]
            total = rest + along[:, j]
    return codes


def fit_books(x: np.ndarray, residual: np.ndarray, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Codebooks of least anisotropic loss: codes and centres in turns."""
    d = x.shape[1]
    w = d // SUBSPACES
    rs, xs = residual.reshape(len(x), SUBSPACES, w), x.reshape(len(x), SUBSPACES, w)
    pick = rng.choice(len(x), CODES, replace=len(x) < CODES)
    books = np.stack([rs[pick, j] for j in range(SUBSPACES)]).astype(np.float32)
    weight = eta(d)
    for _ in range(rounds):
        codes = encode(x, residual, books, weight)
        along = np.stack([((rs[:, j] - books[j][codes[:, j]]) * xs[:, j]).sum(1) for j in range(SUBSPACES)], axis=1)
        total = along.sum(1)
        for j in range(SUBSPACES):
            rest = total - along[:, j]
            for k in range(CODES):
                at = codes[:, j] == k
                if at.any():
                    r, y = rs[at, j], xs[at, j]
                    left = at.sum() * np.eye(w) + (weight - 1) * y.T @ y
                    right = r.sum(0) + (weight - 1) * ((rest[at] + (r * y).sum(1)) @ y)
                    books[j, k] = np.linalg.solve(left, right)
    return books


def fit_index(sample: np.ndarray, rows: int, cell_rows: int = CELL_ROWS) -> Index:
    """The index of a part of few cells, or the coarse one of a part of many."""
    rng = np.random.default_rng(7)
    x = _unit(sample.astype(np.float32))
    cells = int(min(COARSE, max(1, -(-rows // cell_rows)), max(1, len(x) // 4)))
    centroids = fit_centroids(x, cells, rng)
    near = np.argsort(-(x @ centroids.T), axis=1)[:, : min(SPILL, len(centroids))]
    books = fit_books(x, x - centroids[near[:, 0]], rng)
    share = np.bincount(near.ravel(), minlength=len(centroids)) / len(x)
    return Index(centroids, books, np.maximum(1, np.ceil(share * rows / BLOCK_ROWS)).astype(int), centroids, np.empty(0, int))


def refine_index(index: Index, rows: DataFrame, n: int, cell_rows: int) -> Index:
    """The index of a part (rows: id, vector) with the coarse cells of index parted further, in Spark."""
    cells = int(min(MOST_CELLS, -(-n // cell_rows)))
    every = max(1, n // (cells * CELL_SAMPLE))
    held = rows.sparkSession.sparkContext.broadcast(index.coarse)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_matrix(batch.column("vector")) @ held.value.T).argmax(1) if batch.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("vector"), pa.array(near, pa.int32())], names=["vector", "coarse"])

    def part(group: pa.Table) -> pa.Table:
        x = _matrix(group["vector"])
        c = fit_centroids(x, max(1, min(len(x) // 4, round(len(x) / CELL_SAMPLE))), np.random.default_rng(7))
        size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
        return pa.table({"coarse": pa.array([group["coarse"][0].as_py()] * len(c), pa.int32()), "size": pa.array(size, pa.int64()), "centroid": pa.array(list(c), pa.list_(pa.float32()))})

    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(every)) == 0).select("vector")
    found = sample.mapInArrow(place, "vector array<float>, coarse int").groupBy("coarse").applyInArrow(part, "coarse int, size bigint, centroid array<float>").toPandas()
    found = found.sort_values("coarse", kind="stable")
    firsts = np.searchsorted(found["coarse"].to_numpy(), np.arange(len(index.coarse) + 1))
    blocks = np.maximum(1, np.ceil(found["size"].to_numpy() * every * SPILL / BLOCK_ROWS)).astype(int)
    return Index(np.stack(found["centroid"]).astype(np.float32), index.books, blocks, index.coarse, firsts)


def scan(data: np.ndarray, queries: np.ndarray, centroid: np.ndarray, books: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates (query, row, cosine) of batches of unit queries among unit data: about the `keep`
    best by the table scan, with exact cosines."""
    m, c, w = books.shape
    codes = encode(data, data - centroid, books, eta(data.shape[1]))
    pairs = np.ascontiguousarray((codes[:, 0::2] * c + codes[:, 1::2]).T, dtype=np.intp)
    n, batch = len(data), 256
    step = max(1, n // 1024)
    for b in range(0, len(queries), batch):
        q = queries[b : b + batch]
        tables = np.einsum("bmw,mcw->mcb", q.reshape(len(q), m, w), books)
        low = tables.min(axis=(0, 1))
        scale = 255.0 / np.maximum((tables.max(axis=(0, 1)) - low), 1e-9)
        small = ((tables - low) * scale).astype(np.uint16)  # eight bits an entry
        joint = (small[0::2, :, None, :] + small[1::2, None, :, :]).reshape(m // 2, c * c, len(q))
        # In clip mode rows are copied straight to their place.
        score = np.take(joint[0], pairs[0], axis=0, mode="clip")
        held = np.empty_like(score)
        for j in range(1, m // 2):
            np.take(joint[j], pairs[j], axis=0, out=held, mode="clip")
            score += held
        if n > keep * 2:
            some = score[::step]
            rank = min(len(some) - 1, int(np.ceil(keep * len(some) / n * 1.5)) + 2)
            floor = np.partition(some, len(some) - 1 - rank, axis=0)[len(some) - 1 - rank]
            at, of = np.divmod(np.flatnonzero(score >= floor), len(q))
        else:
            at, of = (g.ravel() for g in np.meshgrid(np.arange(n), np.arange(len(q)), indexing="ij"))
        for k in range(0, len(at), 65536):
            i, j = at[k : k + 65536], of[k : k + 65536]
            yield j + b, i, np.einsum("ij,ij->i", data[i], q[j])


def _cell_neighbours(data: np.ndarray, queries: np.ndarray, own: np.ndarray, centroid: np.ndarray, books: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k (query, row, cosine) of each query; own: the query's row in the data, or -1."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, i, s in scan(data, queries, centroid, books, k * RERANK):
        ok = (own[q] != i) & (s >= least)
        found.append((q[ok], i[ok], s[ok]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
    q, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.empty(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    top = rank < k
    return q[top], i[top], s[top]


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has so many finite values, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return _unit(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(flat), -1))


def similar_vectors(vectors: DataFrame, k: int = 10, least: float | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k vectors most alike by cosine to each asked vector of the same part.

    vectors: part (string), id (string), vector (array of float), asked (boolean: whether to search for
    it). Unusable vectors (null, of another length, with missing or infinite values, all zero) and null
    ids are left out. With `least`, only neighbours of at least that cosine count. Rows of an id with
    the same vector are one. Equal cosines go by id. An empty table gives no row; extra columns are
    ignored. Results are approximate in which neighbours are found, exact in their cosines.

    Result: part, id, neighbour, cosine, at most k rows an id.
    """
    spark = vectors.sparkSession
    # A row a part comes to the driver: tables and models.
    rows = vectors.select("part", "id", "vector", F.coalesce("asked", F.lit(True)).alias("asked")).filter("id is not null and part is not null").filter(usable(F.col("vector")))
    counts = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}  # a row per part: tables and models
    indexes: dict[str, Index] = {}
    for part, n in counts.items():
        own = rows.filter(F.col("part") == part)
        every = max(1, -(-n // SAMPLE_ROWS))
        sample = own.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vector").limit(2 * SAMPLE_ROWS).toArrow()
        if sample.num_rows == 0:
            sample = own.select("vector").limit(SAMPLE_ROWS).toArrow()
        index = fit_index(_matrix(sample["vector"]), n, cell_rows)
        indexes[part] = refine_index(index, own, n, cell_rows) if n > COARSE * cell_rows else index
    shared = spark.sparkContext.broadcast(indexes)
    floor = -2.0 if least is None else float(least)

    # Copies of a vector are one row: only the smallest id of a class goes into the cells.
    classes = rows.groupBy("part", "vector").agg(F.min("id").alias("id"), F.bool_or("asked").alias("asked"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            parts = np.array(batch.column("part").to_pylist())
            where, cell, block, role = [], [], [], []
            for part in np.unique(parts):
                index = shared.value[part]
                at = np.flatnonzero(parts == part)
                every_near, every_at = index.nearest(x[at]), at
                for r in range(every_near.shape[1]):
                    at, near = every_at[every_near[:, r] >= 0], every_near[every_near[:, r] >= 0]
                    blocks = index.blocks[near[:, r]]
                    plain = blocks == 1
                    where.append(at[plain]), cell.append(near[plain, r]), block.append(np.zeros(plain.sum(), int)), role.append(np.full(plain.sum(), 3))
                    for i in np.flatnonzero(~plain):
                        # Of a large cell, block b of the queries meets block a of the data in task b * n + a.
                        nb = int(blocks[i])
                        mine = int(at[i]) % nb
                        for other in range(nb):
                            for task, what in ((mine * nb + other, 1), (other * nb + mine, 2)):
                                where.append(at[i : i + 1]), cell.append(near[i : i + 1, r]), block.append(np.array([task])), role.append(np.array([what]))
            take = pa.array(np.concatenate(where))
            out = batch.take(take)
            columns = [*out.columns, pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(block), pa.int32()), pa.array(np.concatenate(role), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*out.schema.names, "cell", "block", "role"])

    dealt = classes.select("part", "id", "vector", "asked").mapInArrow(deal, "part string, id string, vector array<float>, asked boolean, cell int, block int, role int")

    def search(group: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.string()), ("id", pa.string()), ("neighbour", pa.string()), ("cosine", pa.float64())])
        role = group["role"].to_numpy()
        asked = group["asked"].to_numpy(zero_copy_only=False).astype(bool)
        of, among = np.flatnonzero((role & 1 > 0) & asked), np.flatnonzero(role & 2 > 0)
        if not len(of) or not len(among):
            return schema.empty_table()
        part = group["part"][0].as_py()
        index = shared.value[part]
        x = _matrix(group["vector"])
        place = np.full(len(x), -1)
        place[among] = np.arange(len(among))
        q, i, s = _cell_neighbours(x[among], x[of], place[of], index.centroids[group["cell"][0].as_py()], index.books, k, floor)
        ids = group["id"].combine_chunks()
        return pa.Table.from_arrays([pa.array([part] * len(q), pa.string()), ids.take(pa.array(of[q])), ids.take(pa.array(among[i])), pa.array(s.astype(np.float64))], schema=schema)

    # Partitions by rows: a task holds a few cells, whatever the number of rows.
    tasks = max(8, -(-sum(counts.values()) * SPILL // TASK_ROWS))
    near = dealt.repartition(tasks, "part", "cell", "block").groupBy("part", "cell", "block").applyInArrow(search, "part string, id string, neighbour string, cosine double")
    near = near.groupBy("part", "id", "neighbour").agg(F.max("cosine").alias("cosine"))
    # Which ids are copies shows by 96 bits of hash, so that no vector travels for it.
    keyed = rows.select("part", F.xxhash64("vector").alias("h"), F.hash("vector").alias("g"), "id", "asked")
    return _with_copies(near, keyed, k).filter(F.col("cosine") >= floor)


def _with_copies(near: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Neighbours of ids from neighbours of classes: copies of a vector are each other's nearest."""
    several = rows.groupBy("part", "h", "g").agg(F.min("id").alias("class"), F.max("id").alias("last")).filter("class <> last").drop("last")
    # AQE splits the joins on a class where one is hot; the windows below see few rows of it, by salts.
    members = rows.join(several, ["part", "h", "g"]).groupBy("part", "class", "id").agg(F.bool_or("asked").alias("asked"))
    by_id = W.partitionBy("part", "class", "salt").orderBy("id")
    few = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(W.partitionBy("part", "class").orderBy("id"))).filter(F.col("r") <= k + 1)
    few = few.select("part", F.col("class").alias("neighbour"), F.col("id").alias("copy"))
    own = few.select("part", F.col("neighbour").alias("id"), F.col("copy").alias("neighbour"), F.lit(1.0).alias("cosine"))
    spread = near.join(few, ["part", "neighbour"], "left").select("part", "id", F.coalesce("copy", "neighbour").alias("neighbour"), "cosine")
    best = W.partitionBy("part", "id").orderBy(F.desc("cosine"), "neighbour")
    of_class = spread.unionByName(own).groupBy("part", "id", "neighbour").agg(F.max("cosine").alias("cosine"))
    of_class = of_class.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    ids = members.filter("asked").select("part", F.col("class").alias("id"), F.col("id").alias("member"))
    each = of_class.join(ids, ["part", "id"], "left").select("part", F.coalesce("member", "id").alias("id"), "neighbour", "cosine").filter("id <> neighbour")
    return each.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, key: str, model: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat_ws("|", F.lit(name), model).alias("part"), F.col(key).cast("string").alias("id"), F.col("embedding").alias("vector"),
            (F.regexp_replace(F.col(key).cast("string"), r"\D", "").cast("bigint") % 50 == 0).alias("every50"),
        )

    return (
        of("chunk_embeddings", "chunk_id", F.col("model"))
        .unionByName(of("document_chunks", "id", F.lit("")))
        .unionByName(of("do_dop_kakao_chunks", "id", F.lit("")))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(_vectors(spark, sf_dir).withColumn("asked", F.lit(True)), 10, least=0.92)
    return near.select(
        F.split("part", r"\|")[0].alias("table_name"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")
    ).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, against all vectors."""
    near = similar_vectors(_vectors(spark, sf_dir).withColumn("asked", F.col("every50")), 10)
    return near.select(F.split("part", r"\|")[0].alias("table_name"), F.split("part", r"\|")[1].alias("model"), "id", "neighbour", F.round("cosine", 6).alias("cosine"))


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
SQL: dict[str, str] = {}
