"""Connected components by alternating star contraction, and picks within components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.session import cut_lineage


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Least of a node and its neighbours, over undirected (u, v) edges listed both ways."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least_neighbour(both), "u")
    return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least_neighbour(down), "u")
    hop = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hop.unionByName(joined.select("u", F.col("m").alias("v")))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Does every node point down at most once, and never at a node that points on?  One aggregate over the nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), (F.col("v") > F.col("u")).cast("int").alias("met"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("met")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met"))
    return nodes.where("out > 1 OR (out = 1 AND met = 1)").isEmpty()


ROWS_PER_TASK = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) where the component is the least node id; ``edges`` has ``src`` and ``dst``.

    Each round is a min aggregate joined back to the edges, never a neighbour list, and
    ends in a checkpoint.  The rounds end when every edge points at a root: no node that
    is pointed at points anywhere itself, and none points at two.  Tasks are as many as
    the edges fill, so that few edges do not make many small files in every round.
    """
    current = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v").distinct()
    current = cut_lineage(current)
    tasks = 1 + current.count() // ROWS_PER_TASK
    current = current.coalesce(tasks)
    while not _is_forest_of_stars(current):
        starred = _small_star(_large_star(current).coalesce(tasks)).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        current = cut_lineage(starred)
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def component_of_all(nodes: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """Every node with its component; a node without edges is its own."""
    joined = nodes.join(components.withColumnRenamed("node", key), key, "left")
    return joined.withColumn("component", F.coalesce("component", F.col(key)))


def similarity_edges(hits: DataFrame, min_pident: float = 95.0, min_cov: float = 0.9) -> DataFrame:
    """Undirected edges of hits over the identity and both coverage cuts."""
    kept = hits.where(
        (F.col("pident") >= min_pident) & (F.col("qcov") >= min_cov) & (F.col("tcov") >= min_cov)
        & (F.col("query") != F.col("target"))
    )
    return kept.select(F.col("query").alias("src"), F.col("target").alias("dst"))


def longest_member(members: DataFrame, group: str, key: str, length: str) -> DataFrame:
    """Longest member per group, least id on ties, with the group size."""
    return members.groupBy(group).agg(
        F.min_by(key, F.struct(-F.col(length), F.col(key))).alias("representative"), F.count(F.lit(1)).alias("n_members")
    )


def preferred_representative(members: DataFrame, group: str, key: str, given: str) -> DataFrame:
    """The given representative if it is among the members, else the least member id."""
    present = F.bool_or(F.col(key) == F.col(given))
    return members.groupBy(group).agg(
        F.when(present, F.max(given)).otherwise(F.min(key)).alias("representative"), F.count(F.lit(1)).alias("n_members")
    )
