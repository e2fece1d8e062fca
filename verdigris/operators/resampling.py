"""Bootstrap resamples of groups of any size, each group drawn on its own.

Of n scores n are drawn with replacement. A group is cut into leaves of a binary tree by a hash of its rows; how many of the
n draws of an iteration fall into a leaf is found on the way from the root, at each node by a binomial number that only
the node's name decides. So every leaf knows its share without asking another, no task holds a whole group, and a leaf's sums are
all that is added up. A group of one leaf has no binomials, and its draws are a plain hash of group, iteration and place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.stats import same

#: Different rows of a leaf, and draws that are held at once.
LEAF, DRAWS = 4096, 4_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def keys(name: str, iterations: int) -> np.ndarray:
    """32 bits of a digest for each iteration of a leaf."""
    start = hashlib.md5(f"{name}|".encode())
    out = bytearray()
    for b in range(1, iterations + 1):
        one = start.copy()
        one.update(str(b).encode())
        out += one.digest()[:4]
    return np.frombuffer(bytes(out), ">u4").astype(np.uint32)


def _generator(name: str) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.md5(name.encode()).digest(), "big")))


def shares(name: str, total: int, path: list[dict], leaf: int, iterations: int) -> np.ndarray:
    """How many of ``total`` draws fall into a leaf in each iteration. ``path``: the nodes from the root (d, node, whole, left), their rows
    and those of their left halves."""
    count = np.full(iterations, total, np.int64)
    for step in path:
        left = _generator(f"{name}|node|{step['d']}|{step['node']}").binomial(count, step["left"] / step["whole"])
        right = leaf >> (len(path) - 1 - step["d"]) & 1
        count = count - left if right else left
    return count


def sums(values: np.ndarray, times: np.ndarray, name: str, count: np.ndarray) -> np.ndarray:
    """The sum of each iteration's draws from a leaf, whose value i is there ``times[i]`` times."""
    n = int(times.sum())
    if len(values) == 1:
        return values[0] * count
    if n > 2 * LEAF:  # few different values: how often each is drawn, instead of which
        rng, p = _generator(f"{name}|values"), times / n
        step = max(1, DRAWS // len(values))
        return np.concatenate([rng.multinomial(count[a : a + step], p) @ values for a in range(0, len(count), step)])
    each = values if n == len(values) else np.repeat(values, times)
    key, most = keys(name, len(count)), int(count.max())
    places = mix(np.arange(1, most + 1, dtype=np.uint32))
    step = max(1, DRAWS // max(most, 1))
    out = []
    for a in range(0, len(count), step):
        drawn = each[mix(places[None, :] + key[a : a + step, None]) % np.uint32(n)]
        if (count[a : a + step] < most).any():
            drawn = drawn * (np.arange(most)[None, :] < count[a : a + step, None])
        out.append(drawn.sum(axis=1))
    return np.concatenate(out)


def _paths(leaves: DataFrame, by: list[str]) -> DataFrame:
    """(by..., leaf, path): the nodes above each leaf of (by..., depth, leaf, size) with their rows."""
    above = leaves.select(*by, "depth", "size", "leaf", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("d")).withColumn("node", F.expr("shiftright(leaf, depth - d)"))
    nodes = above.groupBy(*by, "d", "node").agg(F.sum("size").alias("whole"))
    halves = nodes.filter("d > 0 AND node % 2 = 0").select(*by, (F.col("d") - 1).alias("d"), F.expr("shiftright(node, 1)").alias("node"), F.col("whole").alias("left"))
    steps = same(above.filter("d < depth").select(*by, "leaf", "d", "node"), same(nodes, halves, [*by, "d", "node"], "left"), [*by, "d", "node"])
    return steps.groupBy(*by, "leaf").agg(F.sort_array(F.collect_list(F.struct("d", "node", "whole", F.coalesce("left", F.lit(0)).alias("left")))).alias("path"))


def bootstrap_means(scores: DataFrame, by: list[str], order: str, iterations: int, seed: int = 42, leaf: int = LEAF) -> DataFrame:
    """(by..., b, m): the mean of a resample of each group's scores, for every iteration.

    Rows that are equal in ``order`` and score are counted before they are shuffled. Groups of at most ``leaf`` different rows
    are one leaf; others have leaves of about that many, one row of the table for each, and their sums are added by iteration. Null scores take no part.
    """
    known = scores.filter("score IS NOT NULL").select(*by, F.col(order).alias("_o"), F.col("score").cast("double").alias("_s"))
    cells = known.groupBy(*by, "_o", "_s").agg(F.count(F.lit(1)).alias("_c"))
    depth = F.when(F.col("cells") > leaf, F.ceil(F.log2(F.col("cells") / leaf))).otherwise(0).cast("int").alias("depth")
    groups = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.sum("_c").alias("total")).select(*by, "total", depth)
    deep = (groups.agg(F.max("depth")).first()[0] or 0) > 0
    place = F.when(F.col("depth") > 0, F.expr("shiftrightunsigned(xxhash64(_o, _s), 64 - depth)")).otherwise(0).cast("long").alias("leaf")
    named = same(cells, groups, by).select(*by, "total", "depth", place, F.struct("_o", "_s", "_c").alias("_row"))
    leaves = named.groupBy(*by, "total", "depth", "leaf").agg(F.sort_array(F.collect_list("_row")).alias("_rows"), F.sum("_row._c").alias("size"))
    if deep:
        leaves = same(leaves, _paths(leaves, by), [*by, "leaf"], "left")
    else:
        leaves = leaves.withColumn("path", F.lit(None).cast("array<struct<d:int,node:bigint,whole:bigint,left:bigint>>"))
    name = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    column = lambda c: F.transform("_rows", lambda x: x[c])

    @F.pandas_udf("array<double>")
    def drawn(names: pd.Series, totals: pd.Series, places: pd.Series, paths: pd.Series, values: pd.Series, times: pd.Series) -> pd.Series:
        out = []
        for group, total, at, path, v, t in zip(names, totals, places, paths, values, times, strict=True):
            count = shares(group, total, [] if path is None else list(path), at, iterations)
            out.append(sums(np.asarray(v, np.float64), np.asarray(t, np.int64), f"{group}|{at}", count) / total)
        return pd.Series(out)

    each = leaves.select(*by, F.posexplode(drawn(name, "total", "leaf", "path", column("_s"), column("_c"))).alias("b", "m"))
    return each.groupBy(*by, "b").agg(F.sum("m").alias("m")) if deep else each
