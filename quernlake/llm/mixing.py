"""Mixing sources to target weights by Pareto order sampling.

Every document of a source expects a number of copies in proportion to its weight. The whole copies
are certain; of the fractions, documents are drawn in the order of their random odds divided by their
inclusion odds until the source's tokens are reached. No sort of a whole source is needed: the ranks
are counted in bins, the bins before the one in which the quota is reached are taken whole, and only
that bin is put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernlake.llm.tokens import encode_corpus
from quernlake.session import bounded_rows, cut, table

#: Bits of a Pareto rank, and those by which its edge is narrowed down in a pass: 4,096 bins a source.
RANK_BITS, BIN_BITS = 48, 12
#: Documents at the edge that may be put in order in one task.
EDGE_ROWS = 10_000
#: Sources a mix may have: their statistics go to the driver.
MOST_SOURCES = 4096


def _weight(bin_: int) -> float:
    """The weight of a document of 2**bin_ to 2**(bin_+1) tokens: longer documents count a little more."""
    return 1.0 + bin_


def expected_copies(bins: dict[int, float], quota: float, max_repeats: int) -> dict[int, float]:
    """The expected copies of a document by size bin, so that the bins' tokens give the quota."""
    capacity = sum(bins.values()) * max_repeats
    if quota >= capacity:
        return {b: float(max_repeats) for b in bins}
    low, high = 0.0, float(max_repeats)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(t * min(mid * _weight(b), max_repeats) for b, t in bins.items()) < quota:
            low = mid
        else:
            high = mid
    return {b: min(high * _weight(b), float(max_repeats)) for b in bins}


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """One mix in which each source has its target share of the tokens.

    documents: doc_id, source, n_tokens. targets: source, target_share, max_repeats, a row per source
    (the least where repeated; more than MOST_SOURCES are an error). Without total_tokens the mix is the
    largest in which every source that has tokens reaches its share; with it, a source that can't fill
    its part within max_repeats is used as far as it goes. Documents of no target's source, of a null
    source, or without tokens are not used, and sources without documents report a share of 0; shares
    are of the mix's tokens, so the others divide up what is missing. Rows of the same doc_id are drawn
    together (the size is the largest). Ties of the rank go by doc_id. Extra columns are ignored.

    Result: (mix, report). mix: doc_id, source, n_tokens, copies. report: source, target_share,
    max_repeats, n_documents, n_used, n_copies, tokens, share.
    """
    spark = documents.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").dropna()
    goals = {r.source: r for r in sorted(bounded_rows(wanted, MOST_SOURCES, "targets"), reverse=True)}
    docs = (
        documents.select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"))
        .filter("n_tokens > 0")
        .filter(F.col("source").isin(list(goals)))
        .groupBy("doc_id", "source")
        .agg(F.max("n_tokens").alias("n_tokens"))
        .withColumn("bin", F.floor(F.log2("n_tokens")).cast("int"))
        .withColumn("u", (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) + 0.5) / F.lit(float(2**52)))
    )
    docs = cut(docs, "mix")
    bins: dict[str, dict[int, float]] = {}
    for r in docs.groupBy("source", "bin").agg(F.sum("n_tokens").alias("t")).collect():  # at most 63 a source
        bins.setdefault(r.source, {})[r.bin] = float(r.t)
    if total_tokens is None:
        full = [sum(b.values()) * goals[s].max_repeats / goals[s].target_share for s, b in bins.items() if goals[s].target_share > 0]
        total_tokens = min(full, default=0.0)
    plan, extra = [], {}
    for s, b in bins.items():
        quota = goals[s].target_share * total_tokens
        copies = expected_copies(b, quota, goals[s].max_repeats)
        plan += [(s, k, int(c), c - int(c)) for k, c in copies.items()]
        extra[s] = min(quota, sum(b.values()) * goals[s].max_repeats) - sum(t * int(copies[k]) for k, t in b.items())
    plan_df = spark.createDataFrame(plan, "source string, bin int, whole int, part double")  # at most 63 rows a source
    # Rank: random odds over inclusion odds, as a probability. A source's quota ends at a rank that is
    # narrowed down by bins of equal width until few documents are left to be put in order.
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    ranked = docs.join(F.broadcast(plan_df), ["source", "bin"]).withColumn("rank", F.when(F.col("part") > 0, F.floor(odds / (1 + odds) * F.lit(float(2**RANK_BITS))).cast("bigint")))
    ranked = cut(ranked, "mix-ranked")
    everything = (0, 2 ** (RANK_BITS + 1))
    ends = {s: (RANK_BITS, 0, extra[s]) for s in bins}  # shift and value of the ranks at the edge, tokens still to draw there
    wide, shift = set(bins), RANK_BITS
    while wide and shift >= BIN_BITS:
        limits = spark.createDataFrame([(s, ends[s][1]) for s in wide], "source string, edge bigint")
        inside = ranked.join(F.broadcast(limits), "source").filter(F.shiftright("rank", shift) == F.col("edge"))
        shift -= BIN_BITS
        counts: dict[str, list[tuple[int, int, int]]] = {}
        for r in inside.groupBy("source", F.shiftright("rank", shift).alias("slot")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect():  # 2**BIN_BITS a source
            counts.setdefault(r.source, []).append((r.slot, r.t, r.n))
        for s in list(wide):
            left, edge, n = ends[s][2], None, 0
            for slot, t, n in sorted(counts.get(s, [])):
                if t > left:
                    edge = slot
                    break
                left -= t
            ends[s] = (*everything, left) if edge is None else (shift, edge, left)
            if edge is None or n <= EDGE_ROWS:
                wide.discard(s)
    edges_df = spark.createDataFrame([(s, *e[:2], float(e[2])) for s, e in ends.items()], "source string, shift int, edge bigint, left double")
    placed = ranked.join(F.broadcast(edges_df), "source").withColumn("slot", F.expr("shiftright(rank, shift)"))
    at_edge = F.coalesce(F.col("slot") == F.col("edge"), F.lit(False))
    w = W.partitionBy("source").orderBy("rank", "doc_id")
    upto = F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, 0))
    # At the edge, a document is in as long as that brings the tokens nearer to the quota.
    last = placed.filter(at_edge).withColumn("drawn", (upto - F.col("n_tokens") / 2 <= F.col("left")).cast("int"))
    others = placed.filter(~at_edge).withColumn("drawn", F.coalesce((F.col("slot") < F.col("edge")).cast("int"), F.lit(0)))
    mix = others.unionByName(last).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("drawn")).alias("copies"))
    used = mix.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("copies") > 0).alias("n_used"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    listed = spark.createDataFrame([(r.source, r.target_share, r.max_repeats) for r in goals.values()], "source string, target_share double, max_repeats int")
    report = listed.join(used, "source", "left").na.fill(0)
    share = F.coalesce(F.col("tokens") / F.sum("tokens").over(W.partitionBy()), F.lit(0.0))  # a row per source
    return mix.filter("copies > 0"), report.withColumn("share", share)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = encode_corpus(docs).select("doc_id", F.size("ids").alias("n_tokens"))
    return docs.select("doc_id", "source").join(sizes, "doc_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
