import math

import numpy as np
import pandas as pd
import pytest

from tests.llm.util import assert_same
from verdigris.llm import mtree, queries


def brute(ids, vectors, query, query_id, k):
    rows = sorted({(-int(v @ query), int(i)) for i, v in zip(ids, vectors, strict=True) if i != query_id})
    return [(-s, i) for s, i in rows[:k]]


@pytest.mark.parametrize(("n", "dim", "spread"), [(1, 3, 50), (65, 2, 3), (3000, 8, 40), (2000, 64, 300), (500, 1, 2)])
def test_search_as_brute_force(n, dim, spread):
    rng = np.random.default_rng(n)
    vectors = rng.integers(-spread, spread + 1, (n, dim))
    vectors[: n // 3] = vectors[0]  # very common vector
    ids = rng.permutation(n * 3)[:n] - n
    tree = mtree.build(pd.DataFrame({"id": ids, "vector": list(vectors / 1024)}), 10)
    for i in range(0, n, max(1, n // 40)):
        assert tree.search(vectors[i].astype(float), ids[i], 10) == brute(ids, vectors, vectors[i], ids[i], 10)
    assert tree.search(np.zeros(dim), 10**9, 10) == brute(ids, vectors, np.zeros(dim, int), None, 10)


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (40, 16))
    vectors = centres[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 16))
    tree = mtree.build(pd.DataFrame({"id": np.arange(4000), "vector": list(vectors / 1024)}), 10)

    def below(number):
        page = tree.pages[number]
        return page.rows if page.children is None else np.concatenate([below(c) for c in page.children])

    for page in tree.pages:
        assert len(page.rows) <= mtree.PAGE
        for k, child in enumerate(page.children or []):
            away = np.sqrt(((tree.points[below(child)] - tree.points[page.rows[k]]) ** 2).sum(axis=1))
            assert away.max() <= page.radii[k] + 1e-6
    assert sorted(below(tree.root).tolist()) == list(range(len(tree.vectors)))
    computed = []
    points = tree.points

    class Counted:
        def __getitem__(self, rows):
            computed.append(np.size(rows))
            return points[rows]

    tree.points = Counted()
    for q in range(0, 4000, 400):
        tree.search(vectors[q].astype(float), q, 10)
    assert sum(computed) < 0.35 * 10 * 4000  # of all distances
    without, computed[:] = sum(computed), []
    for q in range(0, 4000, 400):
        floor = brute(range(4000), vectors, vectors[q], q, 10)[-1][0]
        assert tree.search(vectors[q].astype(float), q, 10, floor) == brute(range(4000), vectors, vectors[q], q, 10)
    assert sum(computed) <= without


def test_cells_pass_over_what_cannot_reach(spark, monkeypatch):
    """Clustered vectors: the same rows as by brute force, and most shards unvisited."""
    monkeypatch.setattr(mtree, "SHARD", 50)
    monkeypatch.setattr(mtree, "BLOCK", 3)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12)) * 3
    of = rng.integers(0, 30, 1500)
    of[:400] = 0
    vectors = np.floor((centres[of] + rng.normal(size=(1500, 12)) * 0.05) * 1024) / 1024
    vectors[:100] = vectors[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)] + [(10_000 + k, [1.0, float(k)]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    visited, searched = [], mtree._searched
    monkeypatch.setattr(mtree, "_searched", lambda trees, visits, k: (visited.append((trees.count(), visits.count())), searched(trees, visits, k))[1])
    got = {}
    for r in mtree.top_k(df, df.filter("vec_id % 50 = 0 or vec_id >= 10000")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    whole = np.floor(vectors * 1024)
    for q in range(0, 1500, 50):
        assert got[q] == brute(range(1500), whole, whole[q], q, 10)
    assert [len(got[10_000 + k]) for k in range(5)] == [4] * 5
    shards = visited[0][0]
    assert sum(n for _, n in visited) < 0.6 * 35 * shards


def test_query_as_sql(spark, monkeypatch):
    for shard, block in ((16_384, 1024), (60, 2)):
        monkeypatch.setattr(mtree, "SHARD", shard)
        monkeypatch.setattr(mtree, "BLOCK", block)
        assert_same(queries.op4_topk(spark, "/root/testdata/sf0.01"), queries.ORACLE_SQL["op4_topk"], "/root/testdata/sf0.01")


def test_edges(spark):
    rows = [(0, [1.0, 0.5], "a"), (1, None, "b"), (2, [1.0, None], "c"), (3, [math.nan, 1.0], "d"), (4, [math.inf, 1.0], "e"), (5, [1.0, 0.5], None), (5, [1.0, 0.5], None), (6, [], "g"), (7, [1.0], "h"), (None, [3.0, 3.0], "i"), (8, [-1.0, 0.0], "j")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").selectExpr("*", "1 as rank", "1 as id")
    got = [tuple(r) for r in mtree.top_k(df, df.filter("vec_id in (0, 1, 7) or vec_id is null")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 1024 * 1024 + 512 * 512), (0, 2, 8, -1024 * 1024)]
    assert mtree.top_k(df.limit(0), df.limit(0)).count() == 0
