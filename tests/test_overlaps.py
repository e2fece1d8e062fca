import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import textmetrics as M


def by_counting(p, r, longest, beta=2.0):
    common, scores = [], []
    for n in range(1, longest + 1):
        a, b = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in (p, r))
        common.append((a & b).total())
        if a and b:
            x, y = common[-1] / a.total(), common[-1] / b.total()
            scores.append((1 + beta * beta) * x * y / (beta * beta * x + y) if x + y else 0.0)
    return common, sum(scores) / len(scores) if scores else 0.0


def made(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abc漢é𝄞 \n") for _ in range(rng.choice([0, 1, 2, 3, 6, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("block", [(256, 1 << 20), (3, 500), (1, 1)])
def test_as_counters(monkeypatch, block):
    monkeypatch.setattr(M, "ROWS", block[0])
    monkeypatch.setattr(M, "POINTS", block[1])
    p, r = made(1, 300) + ["aaaa" * 500, "x"], made(2, 300) + ["aaa" * 900, "x"]
    common, sizes = M.overlaps(p, r, 6)
    want = [by_counting(a, b, 6) for a, b in zip(p, r, strict=True)]
    assert common.T.tolist() == [w[0] for w in want]
    assert np.allclose(M.chrf_values(common, sizes), [w[1] for w in want], rtol=0, atol=1e-12)
    assert M.overlaps([], [], 6)[0].shape == (6, 0)


def test_nulls(spark):
    df = spark.createDataFrame([(1, "ab", "ab"), (2, None, "ab"), (3, "ab", None), (4, None, None), (5, "", "")], "k int, p string, r string")
    got = {r.k: tuple(r)[1:] for r in df.select("k", M.chrf(F.col("p"), F.col("r")), M.char_f1("p", "r"), M.pair_scores("p", "r")["chrf"], M.pair_scores("p", "r")["char_f1"]).collect()}
    assert got == {1: (1.0, 1.0, 1.0, 1.0), 2: (0.0, 0.0, None, None), 3: (0.0, 0.0, None, None), 4: (0.0, 0.0, None, None), 5: (0.0, 0.0, 0.0, 0.0)}


@pytest.mark.parametrize("longest", [1, 4, 6, 7])
def test_native_as_counters(spark, longest):
    p, r = made(3, 120) + ["aaaa" * 50, "x", "\0\0a", "\U0010ffff" * 7, None, "ab"], made(4, 120) + ["aaa" * 90, "x", "\0a\0", "\U0010ffff" * 9, "ab", None]
    df = spark.createDataFrame([(k, *texts) for k, texts in enumerate(zip(p, r, strict=True))], "k int, p string, r string")
    got = {x.k: x.chrf for x in M.chrf_native(df, ["k"], "p", "r", longest=longest).collect()}
    assert len(got) == len(p)
    for k, (a, b) in enumerate(zip(p, r, strict=True)):
        assert abs(got[k] - by_counting(a or "", b or "", longest)[1]) < 1e-12


def test_native_counts_repeated_keys_together(spark):
    df = spark.createDataFrame([(1, "abca", "ab"), (1, "b", "abc"), (2, "ab", "ab")], "k int, p string, r string")
    got = sorted((x.k, round(x.chrf, 9)) for x in M.chrf_native(df, ["k"], "p", "r", longest=2).collect())
    score = sum(5 * a * b / (4 * a + b) for a, b in ((1, 1), (2 / 3, 2 / 3))) / 2
    assert got == [(1, round(score, 9))] * 2 + [(2, 1.0)]


def test_native_exchanges_texts_only(spark):
    """No n-gram is a row."""
    df = spark.createDataFrame([(1, "ab", "ab")], "k int, p string, r string")
    plan = M.chrf_native(df, ["k"], "p", "r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
