from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import items, resampling


def test_tasks_are_drawn_apart(spark):
    """Two equal tasks: their joint interval is narrower by the root of two, as that of independent draws is."""
    rng = np.random.default_rng(1)
    scores = [(float(x), i) for i, x in enumerate(rng.random(100))]
    rows = [("m", t, i, s) for t in ("a", "b") for s, i in scores]
    table = spark.createDataFrame(rows, "model string, task string, id int, score double")
    one = {r.task: r.half_width for r in items.bootstrap_ci(table, ["model", "task"]).collect()}
    both = items.bootstrap_average(table).first().half_width
    assert one["a"] != one["b"] and one["a"] == pytest.approx(one["b"], rel=0.1)
    assert both / ((one["a"] + one["b"]) / 2) == pytest.approx(2**-0.5, rel=0.08)


def test_leaves_share_all_draws():
    """Every iteration's draws are dealt to leaves without one lost, in the proportion of their rows."""
    sizes = np.array([5, 0, 9, 4, 8, 7, 3, 4])
    path = lambda leaf: [{"d": d, "node": leaf >> (3 - d), "whole": int(sizes[(leaf >> (3 - d)) << (3 - d) :][: 1 << (3 - d)].sum()), "left": int(sizes[(leaf >> (3 - d)) << (3 - d) :][: 1 << (2 - d)].sum())} for d in range(3)]
    counts = np.array([resampling.shares("g", 40, path(k), k, 4000) for k in range(8)])
    assert (counts.sum(axis=0) == 40).all()
    assert np.allclose(counts.mean(axis=1), sizes, atol=0.15)
    variance = 40 * (sizes / 40) * (1 - sizes / 40)
    assert np.allclose(counts.var(axis=1), variance, rtol=0.12)


@pytest.mark.parametrize("leaf", [16, 300])
def test_leaves_as_one(spark, leaf):
    """Means of a group of many leaves are spread as those of one; repeated rows count each; reruns and other partitions agree."""
    rng = np.random.default_rng(3)
    rows = [("g", int(i), float(x)) for i, x in enumerate(rng.normal(5, 2, 700))] + [("g", 1000, 30.0)] * 20 + [(None, i, 1.0) for i in range(40)] + [("n", 1, None)]
    table = spark.createDataFrame(rows, "k string, id int, score double")
    found = {}
    for part in (table, table.repartition(5, "score")):
        means = resampling.bootstrap_means(part, ["k"], "id", 1500, leaf=leaf).collect()
        found[len(found)] = {(r.k, r.b): r.m for r in means}
    assert found[0].keys() == found[1].keys() and len(found[0]) == 3000
    assert np.allclose([found[0][k] for k in found[0]], [found[1][k] for k in found[0]])
    got = np.array([m for (k, _), m in found[0].items() if k == "g"])
    values = np.array([s for k, _, s in rows if k == "g"])
    assert got.mean() == pytest.approx(values.mean(), abs=0.02)
    assert got.std() == pytest.approx(values.std() / len(values) ** 0.5, rel=0.06)
    assert {round(m, 12) for (k, _), m in found[0].items() if k is None} == {1.0}


def test_very_often_repeated():
    """A leaf whose few values stand for very many rows is drawn by counts, not by places."""
    values, times = np.array([0.0, 1.0]), np.array([30_000_000, 10_000_000])
    got = resampling.sums(values, times, "n", np.full(3000, 40_000_000)) / 40_000_000
    assert got.mean() == pytest.approx(0.25, abs=1e-5) and got.std() == pytest.approx((0.25 * 0.75 / 4e7) ** 0.5, rel=0.06)


def test_large_group(spark):
    """Half a million scores in 128 leaves, none of them held together."""
    table = spark.range(500_000).select(F.lit("m").alias("model"), F.col("id"), (F.xxhash64("id") % 1000 / 1000).alias("score"))
    got = items.bootstrap_ci(table, ["model"], iterations=200).first()
    sd = table.agg(F.stddev_pop("score")).first()[0]
    assert got.half_width == pytest.approx(1.96 * sd / 500_000**0.5, rel=0.25, abs=1e-4)


def test_matrix_rounds_once(spark):
    """x.xxx4615 is x.xxx, though x.xxx5, its four places, would be rounded up."""
    half_up = lambda x, n: float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))
    rng = np.random.default_rng(0)
    for _ in range(1000):
        a, b = rng.permutation(25), rng.permutation(25)
        rho = float(1 - 6 * ((a - b) ** 2).sum() / (25 * 624))
        if half_up(half_up(rho, 4), 3) != half_up(rho, 3):
            break
    rows = [(int(m), t, float(v[m])) for t, v in (("x", a), ("y", b)) for m in range(25)]
    got = items.redundancy_matrix(spark.createDataFrame(rows, "model int, task string, mean double")).filter("task_a <> task_b").first()
    assert got.rho == half_up(rho, 3) != half_up(half_up(rho, 4), 3)
