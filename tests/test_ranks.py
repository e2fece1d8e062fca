import random
import statistics

import pytest
from pyspark.sql import functions as F

from verdigris.functions import stats


def made(seed, n=400):
    rng = random.Random(seed)
    draw = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 5)), lambda: 7.0, lambda: rng.choice([None, 1.0, -0.0, 0.0])]
    return [(g, draw[k]()) for k, g in enumerate(["a", "b", None, "d"]) for _ in range(n + k)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]


def expected_ranks(values):
    ordered = sorted(values)
    return {v: (2 * ordered.index(v) + 1 + ordered.count(v)) / 2 for v in values}


@pytest.mark.parametrize("sorted_rows", [10**6, 50])
def test_ranks_by_window_and_by_ranges(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(stats, "SORTED", sorted_rows)
    monkeypatch.setattr(stats, "IN_RANGE", 20)
    rows = [(g, v) for g, v in made(1) if v is not None]
    got = {(r.g, r.v): r["rank"] for r in stats.average_ranks(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], "rank").collect()}
    want = {(g, v): rank for g in {g for g, _ in rows} for v, rank in expected_ranks([x for h, x in rows if h == g]).items()}
    assert got == want


@pytest.mark.parametrize("sorted_rows", [10**6, 50])
def test_spearman_both_ways(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(stats, "SORTED", sorted_rows)
    monkeypatch.setattr(stats, "IN_RANGE", 20)
    rng = random.Random(2)
    rows = [(g, x := rng.randint(0, 30), x * g + rng.gauss(0, 9)) for g in (0, 1, 2) for _ in range(300)] + [(0, None, 1.0), (1, 2, None)]
    got = {r.g: r.rho for r in stats.spearman(spark.createDataFrame(rows, "g int, x int, y double"), "x", "y", ["g"]).collect()}
    for g in (0, 1, 2):
        pairs = [(x, y) for h, x, y in rows if h == g and x is not None and y is not None]
        x, y = (expected_ranks(side) for side in zip(*pairs, strict=True))
        assert got[g] == pytest.approx(statistics.correlation([x[p[0]] for p in pairs], [y[p[1]] for p in pairs]), abs=1e-12)


@pytest.mark.parametrize(("most", "n"), [(10**6, 400), (40, 400), (3, 401), (200, 30_000)])
def test_medians(spark, most, n):
    """The exact median, sorted at once or bracketed again and again; even and odd counts, one value, ties and nulls."""
    rows = made(3, n)
    table = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.n, r.m) for r in stats.medians(table, "v", ["g"], "m", most=most).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        if values := [v for h, v in rows if h == g and v is not None]:
            want[g] = len(values), statistics.median(values)
    assert got == want
    whole = stats.medians(table, "v", [], "m", most=most).first()
    assert whole.m == statistics.median([v for _, v in rows if v is not None])


def test_median_of_nothing(spark):
    assert stats.medians(spark.range(0).select(F.lit("g").alias("g"), F.lit(1.0).alias("v")), "v", ["g"], "m").count() == 0
