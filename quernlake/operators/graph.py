"""Graph queries over plain edge DataFrames (src, rel, dst)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlake.session import cut, hot_keys, with_salts

#: Rows of a key above which its rows are dealt out.
HOT_ROWS = 1000


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbours (node, other), each edge in both directions, without loops."""
    e = edges.select("src", "dst").filter("src <> dst")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in (edges) and n_neighbours (distinct nodes)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    near = undirected(edges).groupBy("node").agg(F.count("*").alias("n_neighbours"))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in")).join(near, "node", "left").na.fill(0, ["n_neighbours"])


def without_hubs(edges: DataFrame, most: int) -> DataFrame:
    """Edges between nodes of at most `most` distinct neighbours: hubs aren't expanded."""
    hubs = undirected(edges).groupBy("node").count().filter(F.col("count") > most).select("node")
    return edges.join(hubs.withColumnRenamed("node", "src"), "src", "left_anti").join(hubs.withColumnRenamed("node", "dst"), "dst", "left_anti")


def meet(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Equality join on key; the rows of a hot key of left are dealt out by column `by`, right's copied."""
    hot = hot_keys(left, [key], HOT_ROWS)
    return with_salts(left, [key], hot, HOT_ROWS, by).join(with_salts(right, [key], hot, HOT_ROWS, None), [key, "salt"]).drop("salt")


def paths(edges: DataFrame, starts: DataFrame, most_hops: int, unique: str = "node") -> DataFrame:
    """Directed paths of 1 to most_hops edges from the start nodes (node), each node or each edge at
    most once. edges: edge_id, src, rel, dst. Result: start, end, hops, nodes, rels.

    The number of paths grows with the degree.
    """
    e = edges.select("edge_id", "src", "rel", "dst")
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("end"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("rels"), F.array().cast("array<bigint>").alias("ids"))
    found = None
    for hops in range(1, most_hops + 1):
        step = front.join(e, front["end"] == e["src"])
        fresh = ~F.array_contains("nodes", F.col("dst")) if unique == "node" else ~F.array_contains("ids", F.col("edge_id"))
        front = step.filter(fresh).select("start", F.col("dst").alias("end"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("rels", F.col("rel")).alias("rels"), F.array_append("ids", F.col("edge_id")).alias("ids"))
        part = front.withColumn("hops", F.lit(hops)).drop("ids")
        found = part if found is None else found.unionByName(part)
    return found


def expand(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """Breadth-first expansion from seeds (node), against the direction of edges too: node, round.

    Each round is written out, so that a lost executor costs one round.
    """
    near = cut(undirected(edges), "bfs-near")
    seen = cut(seeds.select("node").distinct().withColumn("round", F.lit(0)), "bfs-0")
    front = seen
    for k in range(1, rounds + 1):
        nxt = near.join(front.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(nxt.withColumn("round", F.lit(k)), f"bfs-{k}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): smallest label of the neighbours and shortcut, in rounds
    until no label changes."""
    near = cut(undirected(edges), "cc-near")
    nodes = cut(near.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("component")), "cc-0")
    for k in itertools.count(1):
        least = near.join(nodes.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("least"))
        hop = nodes.select(F.col("node").alias("component"), F.col("component").alias("lower"))
        step = nodes.join(least, "node").join(hop, "component", "left")
        after = cut(step.select("node", F.least("component", "least", "lower").alias("component"), F.col("component").alias("was")), f"cc-{k}")
        moved = not after.filter("component <> was").isEmpty()
        nodes = after.drop("was")
        if not moved:
            break
    return nodes


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community: each round every node takes its neighbours' most frequent label, the smallest
    of equals. Votes are counted before they are shuffled by node."""
    near = cut(undirected(edges), "lpa-near")
    labels = near.select("node").distinct().withColumn("community", F.col("node"))
    for k in range(rounds):
        votes = near.join(labels.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").count()
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("count")).alias("v"), "community")).alias("b"))
        labels = cut(best.select("node", F.col("b.community").alias("community")), f"lpa-{k}")
    return labels


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: modularity of a partition of the undirected graph."""
    near = undirected(edges)
    m2 = near.count() or 1
    deg = near.groupBy("node").count().join(communities, "node").groupBy("community").agg(F.sum("count").alias("d"))
    of = near.join(communities, "node").join(communities.select(F.col("node").alias("other"), F.col("community").alias("c2")), "other")
    inside = of.filter("community = c2").groupBy("community").agg(F.count("*").alias("l"))
    return deg.join(inside, "community", "left").agg(F.round(F.sum(F.coalesce("l", F.lit(0)) / m2 - (F.col("d") / m2) ** 2), 6).alias("modularity"))


def cliques(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups (node, component) with their size and whether every two of them are a pair (a, b)."""
    size = groups.groupBy("component").agg(F.count("*").alias("size"))
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    counted = both.join(groups.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count("*").alias("n_pairs"))
    return size.join(counted, "component", "left").select("component", "size", (F.coalesce("n_pairs", F.lit(0)) == F.col("size") * (F.col("size") - 1) / 2).alias("is_clique"))
