"""Subject areas of documents by term weighting, truncated singular value decomposition and seed
centroids that are refined in rounds.

Documents are sets of terms weighted by rarity. A randomised decomposition, whose passes run over all
documents in Spark, gives terms and documents vectors in few dimensions; the labels tell how well each
dimension parts the areas. The areas' centroids start from the labelled documents and the areas'
descriptions and are refined by the documents that clearly belong to them. A term is of an area when
its vector lies with that area's centroid and not with another's; a sentence is about the area with
which the sum of its terms has the greatest cosine.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.session import bounded_rows, cut, table

_HTML = re.compile(r"<[^<>]{1,200}>|&(?:[a-z]+|#\d+);")
_FRONT = re.compile(r"\A\s*---\s*\n.*?\n\s*---\s*(?:\n|\Z)", re.S)
_FENCE = re.compile(r"^\s*```.*?^\s*```\s*?$", re.S | re.M)
_SKIP = re.compile(r"^\s*(?:#{1,6}\s|\||https?://|[-*+]\s+https?://)")
_LEAD = re.compile(r"^\s*(?:[-*+>]\s+|\d+[.)]\s+)?(?:\[[ xX]\]\s+)?(?:\d{1,2}:\d{2}\s+)?(?:[\w-]{1,20}:\s+(?=\S+\s))?")
_END = re.compile(r"(?<=[.?!])[\"'”’)]*\s+")
_WORD = re.compile(r"[A-Za-z][A-Za-z-]*|[가-힣]+")
#: Particles that Korean joins to nouns, longest first.
_PARTICLES = sorted(
    "은 는 이 가 을 를 의 에 에서 로 으로 과 와 도 만 부터 까지 보다 라고 이라고 랑 이랑 에는 에게 처럼 마다 이나 나 라는 이라는 과의 와의 로는 으로는".split(), key=len, reverse=True
)
#: Terms in fewer documents than this tell nothing. The MOST_TERMS most frequent, whose vectors of 256 bytes
#: are sent everywhere, fit the decomposition; all others are folded in by joins.
MIN_DOCUMENTS, MAX_SHARE, MOST_TERMS = 5, 0.4, 262_144
RANK, PASSES, ROUNDS = 64, 6, 4
#: Margin between the two best cosines from which a document is clearly of its area, and margin times
#: discriminating part from which a term is of its area.
CLEAR_MARGIN, TERM_SCORE = 0.25, 0.17
MIN_SENTENCES, MIN_SHARE = 2, 0.2


def sentences(text: str) -> list[str]:
    """The sentences of a document: without front matter, code, headings, tables, links and whatever
    doesn't end as a sentence does, such as lists of keywords."""
    text = unicodedata.normalize("NFKC", text).replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n")
    text = _FENCE.sub(" ", _FRONT.sub("", text))
    text = _HTML.sub(lambda m: "\n" if m[0][:2].lower() in ("<p", "</", "<b", "<l", "<d", "<h") else " ", text)
    out = []
    for line in text.split("\n"):
        if _SKIP.match(line):
            continue
        line = _LEAD.sub("", line).strip()
        for s in _END.split(line):
            s = s.strip().rstrip("\"'”’)*_")
            if s and s[-1] in ".?!":
                out.append(s)
    return out


@lru_cache(maxsize=1 << 16)
def _noun(word: str) -> str | None:
    """A Korean word without its particle, if it has one."""
    for p in _PARTICLES:
        if word.endswith(p) and len(word) - len(p) >= 2:
            return word[: -len(p)]
    return None


def terms(sentence: str) -> list[str]:
    """Words and pairs of Latin words, and Korean words with and without their particle."""
    found: dict[str, None] = {}
    before, end = "", -2
    for m in _WORD.finditer(sentence):
        w = m[0]
        if w[0] < "\x80":
            w = w.lower()
            found[w] = None
            if before and m.start() == end + 1:
                found[f"{before} {w}"] = None
            before, end = w, m.end()
        else:
            before = ""
            found[w] = None
            if noun := _noun(w):
                found[noun] = None
    return list(found)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["terms"] = [[terms(s) for s in sentences(t)] for t in batch.pop("text")]
        yield batch


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-12)


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by group, where groups are in order."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(groups):
        first = np.r_[0, np.flatnonzero(np.diff(groups)) + 1]
        out[groups[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _documents(batches: Iterator[pa.RecordBatch], idf: np.ndarray, size: int = 1000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of documents: the batch, and of each of their terms the document, the index and the weight."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            part = batch.slice(k, size)
            column = part.column("ids")
            lengths = np.diff(column.offsets.to_numpy())
            at = np.repeat(np.arange(part.num_rows), lengths)
            ids = column.flatten().to_numpy()
            square = np.bincount(at, idf[ids] ** 2, part.num_rows)
            yield part, at, ids, (idf[ids] / np.sqrt(np.maximum(square, 1e-12))[at]).astype(np.float32)


class Subjects:
    """A fitted model: terms' vectors and the areas' directions."""

    def __init__(self, areas: list[str], idf: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> None:
        self.areas, self.idf, self.vectors, self.weights = areas, idf, vectors, weights
        self.values = np.ones(vectors.shape[1])  # the decomposition's eigenvalues
        self.rest: DataFrame | None = None  # term, idf of those beyond the vocabulary
        self.centroids = np.zeros((len(areas), vectors.shape[1]))

    def directions(self) -> np.ndarray:
        return _unit(self.centroids - self.centroids.mean(0))

    def embed(self, at: np.ndarray, ids: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        return _unit(_sums(self.vectors[ids] * weight[:, None], at, n))

    def topical(self, vectors: np.ndarray | None = None) -> np.ndarray:
        """Whether a term is of an area: near one area only, in dimensions that part the areas."""
        vectors = self.vectors if vectors is None else vectors
        if len(self.areas) < 2:
            return np.ones(len(vectors), bool)
        weighted = vectors * self.weights
        cosine = np.sort(_unit(weighted) @ self.directions().T, axis=1)
        part = np.linalg.norm(weighted, axis=1) / (np.linalg.norm(vectors, axis=1) + 1e-12)
        return (cosine[:, -1] - cosine[:, -2]) * part >= TERM_SCORE


def _gather(coded: DataFrame, function, keys: int, width: int) -> np.ndarray:
    """Sum of matrices (keys, width) that `function` makes of partitions: rows in blocks of 512 are
    added up in Spark, so the driver gets one matrix however many partitions there are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = function(batches).astype(np.float32)
        for k in range(0, keys, 512):
            yield pa.RecordBatch.from_arrays([pa.array([k // 512], pa.int32()), pa.array([total[k : k + 512].tobytes()], pa.binary())], names=["block", "part"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("part"):
                x = np.frombuffer(part.as_py(), np.float32).astype(np.float64)
                total = x if total is None else total + x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "part"])

    summed = coded.mapInArrow(rows, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").collect()
    out = np.zeros((keys, width))
    for r in summed:
        x = np.frombuffer(bytes(r.part), np.float64).reshape(-1, width)
        out[r.block * 512 : r.block * 512 + len(x)] += x
    return out


def fit_subjects(parsed: DataFrame, labels: DataFrame, areas: list[tuple[str, str]]) -> tuple[Subjects, DataFrame]:
    """The model over all parsed documents, and the documents coded by it (doc_id, ids, sentences)."""
    spark = parsed.sparkSession
    n = parsed.count()
    frequent = parsed.select(F.explode(F.array_distinct(F.flatten("terms"))).alias("term")).groupBy("term").count()
    frequent = frequent.filter((F.col("count") >= MIN_DOCUMENTS) & (F.col("count") <= max(2, MAX_SHARE * n)))
    vocabulary = frequent.orderBy(F.desc("count"), "term").limit(MOST_TERMS).collect()
    index = {r.term: k for k, r in enumerate(vocabulary)}
    rest = None
    if len(vocabulary) == MOST_TERMS:
        last = vocabulary[-1]
        beyond = (F.col("count") < last["count"]) | ((F.col("count") == last["count"]) & (F.col("term") > last.term))
        rest = cut(frequent.filter(beyond).select("term", F.log(F.lit(float(max(n, 2))) / F.col("count")).alias("idf")), "subjects-rest")
    idf = np.log(max(n, 2) / np.array([r["count"] for r in vocabulary] or [1], np.float64)).astype(np.float32)
    shared = spark.sparkContext.broadcast(index)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            coded = [[[known[t] for t in s if t in known] for s in d] for d in batch.pop("terms")]
            batch["sentences"] = coded
            batch["ids"] = [sorted({t for s in d for t in s}) for d in coded]
            yield batch

    coded = cut(parsed.mapInPandas(code, "doc_id bigint, sentences array<array<int>>, ids array<int>"), "subjects-coded")
    rng = np.random.default_rng(11)
    rank = min(RANK, len(idf))
    basis = np.linalg.qr(rng.standard_normal((len(idf), rank)))[0].astype(np.float32)
    product = basis
    for _ in range(PASSES):
        held = spark.sparkContext.broadcast(basis)

        def multiply(batches: Iterator[pa.RecordBatch], held=held) -> np.ndarray:
            o = held.value
            total = np.zeros(o.shape, np.float64)
            for part, at, ids, weight in _documents(batches, idf):
                y = _sums(o[ids] * weight[:, None], at, part.num_rows)
                order = np.argsort(ids, kind="stable")
                total += _sums(y[at[order]] * weight[order, None], ids[order], len(o))
            return total

        product = _gather(coded, multiply, len(idf), rank)
        held.unpersist()
        if _ < PASSES - 1:
            basis = np.linalg.qr(product)[0].astype(np.float32)
    values, turn = np.linalg.eigh(basis.T @ product)
    vectors = (basis @ turn[:, ::-1]).astype(np.float32)
    names = [a for a, _ in areas]
    model = Subjects(names, idf, vectors, np.ones(rank, np.float32))
    # Weak dimensions aren't blown up by what is folded in.
    model.values = np.maximum(values[::-1], max(0.1 * values[-1], 1e-9)) if len(values) else values
    place = {a: k for k, a in enumerate(names)}
    # Seeds: documents labelled with one area.
    single = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("area").alias("area"), F.max("area").alias("other"), F.count_if(F.col("area").isNull()).alias("none"))
    single = single.filter("area = other and none = 0").select("doc_id", "area")
    seeds = coded.select("doc_id", "ids").join(single, "doc_id")
    held = spark.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((len(names), 2 * rank + 1))
        for part, at, ids, weight in _documents(batches, idf):
            e = held.value.embed(at, ids, weight, part.num_rows)
            which = np.array([place.get(a, -1) for a in part.column("area").to_pylist()], int)
            ok = (which >= 0) & (np.abs(e).sum(1) > 0)
            np.add.at(total, which[ok], np.c_[e[ok], e[ok] ** 2, np.ones(ok.sum())])
        return total

    sums = _gather(seeds, moments, len(names), 2 * rank + 1)
    for k, (_, description) in enumerate(areas):
        ids = np.array(sorted({index[t] for t in terms(description or "") if t in index}), int)
        if len(ids):
            e = _unit((vectors[ids] * idf[ids, None]).sum(0))
            sums[k] += np.r_[e, e**2, 1.0]
    number = np.maximum(sums[:, -1:], 1)
    mean = sums[:, :rank] / number
    within = (sums[:, rank:-1] / number - mean**2).mean(0)
    model.weights = (mean.var(0) / (mean.var(0) + within + 1e-12)).astype(np.float32)
    model.centroids = _unit(mean * model.weights)
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(model)

        def clear(batches: Iterator[pa.RecordBatch], held=held) -> np.ndarray:
            m = held.value
            total = np.zeros((len(m.areas), rank))
            for part, at, ids, weight in _documents(batches, idf):
                z = _unit(m.embed(at, ids, weight, part.num_rows) * m.weights)
                cosine = z @ m.directions().T
                top = np.sort(cosine, axis=1)
                sure = top[:, -1] - top[:, -2] >= CLEAR_MARGIN if cosine.shape[1] > 1 else np.abs(z).sum(1) > 0
                np.add.at(total, cosine.argmax(1)[sure], z[sure])
            return total

        found = _gather(coded, clear, len(names), rank)
        filled = np.abs(found).sum(1) > 0
        model.centroids = model.centroids.copy()
        model.centroids[filled] = _unit(found[filled])
    model.rest = rest
    return model, coded


def fold_in(model: Subjects, parsed: DataFrame, coded: DataFrame) -> DataFrame:
    """coded with `extra`: of each sentence (s) the sum (w) of its topical terms beyond the vocabulary.

    Such a term's vector is what the decomposition would give it, the weighted sum of its documents'
    vectors over the eigenvalues; documents and terms meet by joins, and sums are made in the JVM.
    """
    rest, model.rest = model.rest, None
    held, rank = parsed.sparkSession.sparkContext.broadcast(model), model.vectors.shape[1]

    def document_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part, at, ids, weight in _documents(batches, m.idf):
            y = _sums(m.vectors[ids] * weight[:, None], at, part.num_rows)
            norm = np.sqrt(np.maximum(np.bincount(at, m.idf[ids] ** 2, part.num_rows), 1e-12))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list((y / norm[:, None]).astype(np.float32)), pa.list_(pa.float32()))], names=["doc_id", "y"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            idf = batch.column("idf").to_numpy()
            v = np.array(batch.column("v").flatten()).reshape(batch.num_rows, -1) * idf[:, None] / m.values
            of = np.flatnonzero(m.topical(v)) if batch.num_rows else np.empty(0, int)
            w = (v * m.weights * idf[:, None])[of].astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(of)), pa.array(list(w), pa.list_(pa.float32()))], names=["term", "w"])

    each = parsed.select("doc_id", F.posexplode("terms").alias("s", "t")).select("doc_id", "s", F.explode("t").alias("term")).distinct()
    each = cut(each.join(rest, "term"), "subjects-beyond")
    of_documents = coded.select("doc_id", "ids").mapInArrow(document_vectors, "doc_id bigint, y array<float>")
    summed = lambda c: F.array(*(F.sum(F.col(c)[k].cast("double")) for k in range(rank)))
    vectors = each.select("doc_id", "term", "idf").distinct().join(of_documents, "doc_id").groupBy("term", "idf").agg(summed("y").alias("v"))
    topical = vectors.mapInArrow(judge, "term string, w array<float>")
    sentences_of = each.join(topical, "term").groupBy("doc_id", "s").agg(summed("w").alias("w"))
    return coded.join(sentences_of.groupBy("doc_id").agg(F.collect_list(F.struct("s", "w")).alias("extra")), "doc_id", "left")


def assign_subjects(documents: DataFrame, labels: DataFrame, areas: list[tuple[str, str]]) -> DataFrame:
    """The areas that documents are about.

    documents: doc_id, text. labels: doc_id, area (null for none; wrong and repeated ones are borne).
    areas: (area, description), a bounded list. An area counts with at least MIN_SENTENCES sentences,
    and a share of MIN_SHARE of the document's sentences that are about any area. Null, empty and
    texts without sentences have no area; texts are read whole; repeated rows count each for the model
    and give one result; extra columns are ignored; without documents or areas there is no row.

    Result: doc_id, area, n_sentences (about the area), n_about (about any).
    """
    spark = documents.sparkSession
    shape = "doc_id bigint, area string, n_sentences int, n_about int"
    given = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null and doc_id is not null")
    parsed = cut(given.mapInPandas(_parse, "doc_id bigint, terms array<array<string>>"), "subjects-parsed")
    if not areas or parsed.isEmpty():
        return spark.createDataFrame([], shape)
    model, coded = fit_subjects(parsed, labels.select("doc_id", "area"), areas)
    coded = coded.select("doc_id", "sentences", "ids")
    coded = fold_in(model, parsed, coded) if model.rest is not None else coded.withColumn("extra", F.lit(None).cast("array<struct<s:int,w:array<double>>>"))
    shared = spark.sparkContext.broadcast((model, model.topical(), model.directions()))

    def about(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, topical, directions = shared.value
        weighted = m.vectors * m.weights * m.idf[:, None]
        for batch in batches:
            outer = batch.column("sentences")
            inner = outer.flatten()
            lengths = np.diff(inner.offsets.to_numpy())
            sentence = np.repeat(np.arange(len(inner)), lengths)
            ids = inner.flatten().to_numpy()
            of = topical[ids]
            sentence, ids = sentence[of], ids[of]
            best = np.full(len(inner), -1)
            # What terms beyond the vocabulary add to sentences.
            extra = batch.column("extra")
            whose = np.repeat(outer.offsets.to_numpy()[:-1] - outer.offsets.to_numpy()[0], np.diff(extra.offsets.to_numpy()))
            more = whose + extra.flatten().field("s").to_numpy() if len(whose) else np.empty(0, int)
            added = np.array(extra.flatten().field("w").flatten()).reshape(len(more), directions.shape[1])
            # In slices, by sentence.
            for k in range(0, len(inner), 20_000):
                lo, hi = np.searchsorted(sentence, [k, k + 20_000])
                here = np.unique(sentence[lo:hi])
                total = _sums(weighted[ids[lo:hi]], sentence[lo:hi] - k, min(20_000, len(inner) - k))
                mine = (more >= k) & (more < k + 20_000)
                if mine.any():
                    np.add.at(total, more[mine] - k, added[mine])
                    here = np.union1d(here, more[mine])
                best[here] = (total[here - k] @ directions.T).argmax(1)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(outer.offsets.to_numpy()))
            told = best >= 0
            count = np.bincount(doc[told] * len(m.areas) + best[told], minlength=batch.num_rows * len(m.areas)).reshape(batch.num_rows, -1)
            whole = count.sum(1, keepdims=True)
            rows, which = np.nonzero((count >= MIN_SENTENCES) & (count >= MIN_SHARE * whole))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array([m.areas[a] for a in which], pa.string()), pa.array(count[rows, which], pa.int32()), pa.array(whole[rows, 0], pa.int32())],
                names=["doc_id", "area", "n_sentences", "n_about"],
            )

    return coded.select("doc_id", "sentences", "extra").mapInArrow(about, shape).groupBy("doc_id", "area").agg(F.max("n_sentences").alias("n_sentences"), F.max("n_about").alias("n_about"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = [(r.area, r.description) for r in sorted(bounded_rows(table(spark, sf_dir, "subject_areas"), 1024, "areas"))]
    return assign_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), areas)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "area")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per area; those of several count for each in equal parts, those of none as null."""
    found = cut(_found(spark, sf_dir), "subjects-found")
    parts = found.join(found.groupBy("doc_id").agg(F.count("*").alias("k")), "doc_id").select("doc_id", "area", (1 / F.col("k")).alias("part"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    whole = docs.join(parts, "doc_id", "left")
    return whole.groupBy("area").agg(F.count("*").alias("n_documents"), F.round(F.sum(F.coalesce("part", F.lit(1.0))), 6).alias("weight"))


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition}
SQL: dict[str, str] = {}
