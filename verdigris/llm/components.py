"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.store import release, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the links (a, b), both long and not null.

    Large stars link a node's larger neighbours to its least neighbour, small stars do so with the
    smaller ones; in a few rounds every node hangs at its component's least. Each step is a minimum by
    node and a join with it, both of which Spark can split at a node with very many links, and is
    stored, so that a lost executor costs no earlier round. Nothing is collected but a checksum.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before or state.n == 0:
            break
        before = state
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least, old = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "stars-least"), edges
        edges = stored(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "stars")
        release(least, old)
        least, old = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "stars-least"), edges
        linked = edges.join(least, "a")
        edges = stored(linked.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        release(least, old)
    roots = edges.select(F.col("b").alias("node")).distinct()
    found = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component"))), "components")
    release(edges)
    return found
