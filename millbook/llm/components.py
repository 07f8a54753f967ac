"""Connected components of a link graph, as rounds of joins.

Alternating large-star and small-star steps: each points the neighbours of a
node at the smallest node among them, first the larger neighbours, then the
smaller ones. The edge list never grows, every step is one grouped minimum
(combined map-side) and one join, and the graph is a set of stars after a
number of rounds logarithmic in the longest chain. Nothing is collected; the
driver only learns whether a round left stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millbook.plans.lineage import staged


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node ``u`` to the smaller ``v``."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star")
    # a node's larger neighbours are told its smallest neighbour
    told = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u")
    return told.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
    told = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return told.unionByName(low.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one other and none points at a node that points on."""
    on = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return on.isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node with a link: the smallest node it can reach.

    ``links`` holds undirected links between long ids in columns ``a``, ``b``;
    repeated links and loops are allowed, nulls are ignored. A node whose only
    links are loops is not returned.
    """
    edges = staged(_directed(links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()), "edges")
    while not _stars(edges):
        edges = staged(_directed(_small_star(staged(_directed(_large_star(edges)), "edges"))), "edges")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
