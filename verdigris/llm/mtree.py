"""Exact top-k by inner product with M-trees.

Vectors are lifted to one norm, which turns the greatest inner product into the least Euclidean
distance. A tree's nodes are pages of entries; an entry keeps its distance to the page's parent and a
covering radius, so that most distances need not be computed: the triangle inequality bounds them.

Vectors are dealt into cells by their nearest of a few pivots, and cells into shards that have a tree
each. A query visits a shard of its nearest cell first; the k-th score found there bounds the rest of its search:
cells whose covering radius can't reach it are passed over, and so are pages of the other trees. Trees go to the
queries' tasks once, not once for each query.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdigris.llm.arrow import mapped
from verdigris.llm.store import least_hashed, small, stored

#: Entries of a page, vectors of a tree, queries that one copy of a tree answers and cells, at most or about.
PAGE, SHARD, BLOCK, CELLS = 64, 16_384, 4096, 256
SCALE = 1024


@dataclass
class Page:
    """Entries: the rows of ``points`` they stand for, their distances to the parent and covering radii (0 in a leaf), and child pages (none in a leaf)."""

    rows: np.ndarray
    to_parent: np.ndarray
    radii: np.ndarray
    children: list[int] | None


class MTree:
    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray]):
        """``vectors``: whole numbers, distinct rows; ``ids``: ascending ids of each row."""
        self.vectors, self.ids = vectors, ids
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.lift = np.sqrt(np.maximum(self.top - norms, 0))
        self.points = np.concatenate([vectors.astype(np.float64), self.lift[:, None]], axis=1)
        self.pages: list[Page] = []
        self.root = self._build()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "points"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self.points = np.concatenate([self.vectors.astype(np.float64), self.lift[:, None]], axis=1)

    def _groups(self, rows: np.ndarray) -> list[np.ndarray]:
        """Splits rows by the nearer of two far pivots until each part fits a page."""
        todo, done = [rows], []
        while todo:
            part = todo.pop()
            if len(part) <= PAGE:
                done.append(part)
                continue
            x = self.points[part]
            a = ((x - x[0]) ** 2).sum(axis=1).argmax()
            to_a = ((x - x[a]) ** 2).sum(axis=1)
            b = to_a.argmax()
            gap = to_a - ((x - x[b]) ** 2).sum(axis=1)
            # the middle keeps pages full and the depth logarithmic
            order = np.argsort(gap, kind="stable")
            half = len(part) // 2
            todo += [part[order[:half]], part[order[half:]]]
        return done

    def _build(self) -> int:
        level = np.arange(len(self.vectors))
        radii, children = np.zeros(len(level)), None
        while True:
            where = {int(r): k for k, r in enumerate(level)}
            heads, head_radii, numbers = [], [], []
            for part in self._groups(level):
                at = np.array([where[int(r)] for r in part], np.int64)
                x = self.points[part]
                middle = ((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin() if len(part) else 0
                away = np.sqrt(((x - x[middle]) ** 2).sum(axis=1)) if len(part) else np.zeros(0)
                self.pages.append(Page(part, away, radii[at], None if children is None else [children[k] for k in at]))
                numbers.append(len(self.pages) - 1)
                heads.append(int(part[middle]) if len(part) else 0)
                head_radii.append(float((away + radii[at]).max()) if len(part) else 0.0)
            if len(numbers) == 1:
                self.head, self.head_radius = heads[0], head_radii[0]
                return numbers[0]
            # routing objects of different pages differ: a page's rows are its own
            level, radii, children = np.array(heads), np.array(head_radii), numbers

    def search(self, query: np.ndarray, query_id: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) of a score of ``floor`` at least, best first, ties to the smaller id; ``query_id`` is left out."""
        if not len(self.vectors):
            return []
        q = np.append(query.astype(np.float64), 0.0)
        base = float(q @ q) + self.top
        slack = 1e-7 * (1 + base**0.5)
        best: list[tuple[int, int]] = []  # a heap whose first is the worst: (score, -id)
        limit = np.inf if floor == -np.inf else float(np.sqrt(max(0.0, base - 2 * floor)))
        to_head = float(np.sqrt(((self.points[self.head] - q) ** 2).sum()))
        queue = [(max(0.0, to_head - self.head_radius), self.root, to_head)]
        while queue:
            bound, number, to_parent = heapq.heappop(queue)
            if bound > limit + slack:
                break
            page = self.pages[number]
            near = np.flatnonzero(np.abs(to_parent - page.to_parent) - page.radii <= limit + slack)
            if not len(near):
                continue
            rows = page.rows[near]
            products = self.points[rows] @ q
            if page.children is not None:
                away = np.sqrt(np.maximum(base - 2 * products, 0))
                lower = np.maximum(away - page.radii[near], 0)
                for i in np.flatnonzero(lower <= limit + slack):
                    heapq.heappush(queue, (float(lower[i]), page.children[near[i]], float(away[i])))
                continue
            worst = best[0][0] if len(best) == k else floor
            for i in np.flatnonzero(products >= worst):
                score = int(products[i])
                for other in self.ids[rows[i]].tolist():
                    if other == query_id:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -other))
                    elif (score, -other) > best[0]:
                        heapq.heapreplace(best, (score, -other))
                    else:
                        break
            if len(best) == k:
                limit = float(np.sqrt(max(0.0, base - 2 * best[0][0])))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def build(pdf: pd.DataFrame, k: int) -> MTree:
    """A tree of (id, vector) rows. Of equal vectors only the k + 1 least ids can be among a query's k best."""
    ids = pdf["id"].to_numpy(np.int64)
    vectors = np.floor(SCALE * np.stack(pdf["vector"].to_numpy()).astype(np.float64)) if len(pdf) else np.zeros((0, 0))
    order = np.argsort(ids, kind="stable")
    distinct, of = np.unique(vectors[order], axis=0, return_inverse=True)
    of = of.ravel()
    by_vector = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[by_vector], np.arange(len(distinct) + 1))
    lists = [np.unique(ids[order][by_vector[a:b]])[: k + 1] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    small = np.int16 if len(distinct) and np.abs(distinct).max() < 2**15 else np.float64
    return MTree(distinct.astype(small), lists)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k greatest inner products of floor(1024 * x)
    over all rows of other ids, all if fewer, ties to the smaller id.

    Both tables have ``id_col`` and ``vector_col``; other columns play no part. Vectors that are null,
    empty or hold null, NaN or infinite components, and null ids, take no part. Only vectors of one length
    compare. Rows that repeat an id and vector count once; an id with two vectors counts with both.
    Scores are exact below 2**53.
    """

    def valid(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        good = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return df.filter(good).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("vector"), F.size(x).alias("dim"))

    table, asked = valid(vectors), valid(queries)
    cells = Cells(table)
    parts = stored(cells.dealt(table).groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts")), "mtree-parts")

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in KEYS}, "radius": [pdf["away"].max()], "tree": [pickle.dumps(build(pdf, k))]})

    # a vector as near to two pivots may change its cell from one run to the next: radii and shards are those of the trees
    parted = cells.dealt(table).join(small(parts), ["dim", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    trees = stored(parted.select(*KEYS, "id", "vector", "away").groupBy(*KEYS).applyInPandas(tree, "dim int, cell int, part int, radius double, tree binary"), "mtree-pages")
    cells.measure(trees.groupBy("dim", "cell").agg(F.max("radius").alias("radius")))
    trees = trees.drop("radius")
    shards = stored(trees.select(*KEYS), "mtree-shards")
    sized = stored(shards.groupBy("dim", "cell").agg((F.max("part") + 1).alias("parts")), "mtree-cells")
    # the nearest cell first
    none = F.lit(None).cast("double")
    near = cells.dealt(asked, inner=True).join(small(sized), ["dim", "cell"])
    near = stored(near.select(*KEYS[:2], F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "vector", none.alias("floor")), "mtree-near")
    first = stored(_searched(trees, near, k), "mtree-first")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = first.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    floors = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).cast("double").alias("floor"))
    # then all other shards of cells that can reach the score of rank k
    rest = near.drop("floor").join(floors, "id", "left").withColumnsRenamed({"cell": "home", "part": "home_part"})
    reach = cells.reached(rest).join(small(shards), ["dim", "cell"])
    others = stored(reach.filter((F.col("cell") != F.col("home")) | (F.col("part") != F.col("home_part"))).select(*KEYS, "id", "vector", "floor"), "mtree-others")
    found = first.unionByName(_searched(trees, others, k))
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


KEYS = ["dim", "cell", "part"]


class Cells:
    """Pivots, at most CELLS rows of the table, and the radius that each one's cell has. Vectors of a length that no pivot has are in cell -1, which every query of that length visits."""

    def __init__(self, table: DataFrame):
        most = min(CELLS, -(-table.count() // SHARD))
        rows = least_hashed(table, ["id", "vector"], most).collect() if most else []
        self.pivots = {d: np.unique(np.array([r.vector for r in rows if r.dim == d], np.float64), axis=0) for d in {r.dim for r in rows}}
        self.radii: dict[int, np.ndarray] = {}

    def measure(self, sized: DataFrame) -> None:
        """Takes the radii from (dim, cell, radius): a row for each pivot."""
        self.radii = {d: np.full(len(p), -np.inf) for d, p in self.pivots.items()}
        for r in sized.filter("cell >= 0").collect():
            self.radii[r.dim][r.cell] = r.radius

    def _by_dim(self, df: DataFrame, make: Callable[[np.ndarray, np.ndarray, int, pa.RecordBatch], list[pa.Array]], keep: list[str], schema: str) -> DataFrame:
        """``make`` of (rows, vectors, length, batch) for each length of vectors in a batch; it gives the rows' numbers and the new columns."""

        names = T.StructType.fromDDL(schema).names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for d in np.unique(dims).tolist():
                    rows = np.flatnonzero(dims == d)
                    x = batch.column("vector").take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d)
                    at, *new = make(rows, x, d, batch)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in keep), *new], names=names)

        return mapped(df.select(*keep), run, schema)

    def dealt(self, df: DataFrame, inner: bool = False) -> DataFrame:
        """(id, vector, dim, cell, away): the nearest pivot, and how far it is. ``inner``: that of the greatest inner product, where a query's best are likely."""
        pivots, shift = self.pivots, self.radii if inner else {}

        def make(rows: np.ndarray, x: np.ndarray, d: int, batch: pa.RecordBatch) -> list:
            if d not in pivots:
                return [rows, pa.array(np.full(len(rows), -1, np.int32)), pa.array(np.full(len(rows), np.inf))]
            p = pivots[d]
            if inner:
                cell = np.where(np.isfinite(shift[d]), x @ p.T, -np.inf).argmax(axis=1)
            else:
                cell = ((p**2).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
            return [rows, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(((x - p[cell]) ** 2).sum(axis=1)))]

        return self._by_dim(df, make, ["id", "vector", "dim"], "id long, vector array<double>, dim int, cell int, away double")

    def reached(self, df: DataFrame) -> DataFrame:
        """A row for each cell that may hold a score of a query's floor: an inner product is at most the pivot's plus the query's norm times the radius."""
        pivots, radii = self.pivots, self.radii

        def make(rows: np.ndarray, x: np.ndarray, d: int, batch: pa.RecordBatch) -> list:
            if d not in pivots:
                return [rows, pa.array(np.full(len(rows), -1, np.int32))]
            floor = batch.column("floor").take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.float64)
            # scores are of whole numbers floor(SCALE * x), at most one off in each component
            whole, norm = np.floor(SCALE * x), np.sqrt((np.floor(SCALE * x) ** 2).sum(axis=1))
            most = whole @ (SCALE * pivots[d]).T + norm[:, None] * (SCALE * radii[d] + np.sqrt(d))
            at, cell = np.nonzero(~(most * (1 + 1e-9 * np.sign(most)) + 1 < np.where(np.isnan(floor), -np.inf, floor)[:, None]) & np.isfinite(radii[d]))
            return [rows[at], pa.array(cell.astype(np.int32))]

        return self._by_dim(df, make, ["id", "vector", "dim", "floor", "home", "home_part"], "id long, vector array<double>, dim int, floor double, home int, home_part int, cell int")


def _searched(trees: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) from visits (dim, cell, part, id, vector, floor): a tree and its queries meet in one task, in several if there are many."""
    copies = stored(visits.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("copies")), "mtree-copies")
    sent = trees.join(copies, KEYS).select(*KEYS, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("double").alias("floor"), "tree")
    asked = visits.join(copies, KEYS).select(*KEYS, F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("copy"), "id", "vector", "floor", F.lit(None).cast("binary").alias("tree"))
    together = sent.unionByName(asked).repartition(*KEYS, "copy").sortWithinPartitions(*KEYS, "copy", F.col("id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            found = []
            for raw, query, vector, floor in zip(*(batch.column(c) for c in ("tree", "id", "vector", "floor")), strict=True):
                if raw.is_valid:
                    held = pickle.loads(raw.as_py())
                    continue
                q, i = np.floor(SCALE * vector.values.to_numpy()), query.as_py()
                found += [(i, other, score) for score, other in held.search(q, i, k, floor.as_py() if floor.is_valid else -np.inf)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return mapped(together.select("tree", "id", "vector", "floor"), run, "query_id long, vec_id long, score long")
