import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import assert_same
from verdigris.llm import outliers, store
from verdigris.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_words string, gid int, d string, own_0 int, kept int"
MORE = ("9", 1, "d", 2, 3)


def base(text):
    text = text or ""
    words = text.translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def made(n, seed):
    """Documents of two sources, one of them hot, one in ten with signs."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        odd = k % 10 == 9
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(int(rng.lognormvariate(5, 0.7)) + 12)]
        words = [w + "$#" if odd and rng.random() < 0.9 else w for w in words]
        rows.append((k, "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)), ("xx", None)[k % 4 == 0], ("hot", "b", None)[0 if k % 3 else k % 2 + 1], *MORE))
    return rows


def test_counts_by_hand(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e f", "a a a a a a", "x\nx\n\nx \ny", "é# 漢字<>\xa0z\x0bw|", "one two three four", "a b c d e " * 3, "w " * 100_000, " ".join(map(str, range(30_000)))]
    rng = random.Random(1)
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.inline(F.array(outliers.counts(F.col("t"))))).collect()
    assert {r.k: tuple(r)[1:] for r in got} == {k: base(t) for k, t in enumerate(texts)}


def test_estimates_as_numpy(spark):
    """The estimates by numpy's covariance and Cholesky root, and a determinant no larger than that of sets drawn at random."""
    rng = np.random.default_rng(2)
    x = np.rint(rng.multivariate_normal([3000, 800, 40, 0, 60], np.diag([200, 40, 20, 30, 25]) ** 2 + 200, 3000)).astype(int)
    x[::8] += [0, 0, 300, 0, 400]
    table = spark.createDataFrame([("g", *map(int, r)) for r in x], "gid string, x0 long, x1 long, x2 long, x3 long, x4 long")
    found = outliers.estimates(table, steps=8).first().asDict()
    root = np.zeros((5, 5))
    for i, j in outliers.PAIRS:
        root[i, j] = found[f"l{i}{j}"]
    mean = np.array([found[f"m{i}"] for i in range(5)])
    floors = np.diag((np.array(outliers.FLOORS) * outliers.UNITS) ** 2)
    d = np.sqrt((np.linalg.solve(root, (x - mean).T) ** 2).sum(0))
    near = np.floor(32 * d) <= np.floor(32 * np.sort(d)[int(np.ceil(0.75 * len(d))) - 1])
    after = np.cov(x[near].T, bias=True) + floors
    assert np.linalg.det(after) == pytest.approx(np.linalg.det(root) ** 2, rel=0.05)  # near a fixed point
    assert np.allclose(np.diag(after), np.diag(root @ root.T), rtol=0.05)
    assert np.allclose(x[near].mean(0), mean, atol=8) and not near[::8].any()
    least = min(np.linalg.det(np.cov(x[np.argsort(((x - x[s].mean(0)) ** 2 / x[s].var(0)).sum(1))[: int(near.sum())]].T, bias=True) + floors) for s in (rng.integers(0, 3000, 12) for _ in range(50)))
    assert np.linalg.det(root) ** 2 <= least * 1.05


def test_odd_documents_go(spark, monkeypatch):
    rows = made(1500, 1)
    table = spark.createDataFrame(rows, DOCS)
    first = {r.doc_id: r for r in outliers.judge(table).collect()}
    assert sorted(k for k, r in first.items() if not r.base_failed and not r.kept) == [k for k in range(9, 1500, 10)]
    assert {k: tuple(r[c] for c in outliers.BASE) for k, r in first.items()} == {k: base(t) for k, t, *_ in rows}
    assert first[0].asDict().keys() == {"doc_id", "text", "lang", "source", "gid", "d", "own_0", *outliers.BASE, "base_failed", "distance", "kept"}
    monkeypatch.setattr(store, "MOST_BYTES", 0)  # joins by sorting
    again = {r.doc_id: r.distance for r in outliers.judge(table.repartition(7, "text"), keep=["doc_id"]).collect()}
    assert again == {k: r.distance for k, r in first.items()}  # to the last bit, however rows are dealt


def test_groups(spark):
    rows = [("a", "s")] * 6 + [("a", "t")] * 3 + [("a", None)] * 2 + [("b", "s")] * 2 + [(None, "s")] * 3 + [("null", "s")] * 5
    got = {(r.lang, r.source): r.gid for r in outliers.groups(spark.createDataFrame(rows, "lang string, source string"), 5).collect()}
    assert got[("a", "t")] == got[("a", None)] != got[("a", "s")]
    assert got[("b", "s")] == got[(None, "s")] == "3" and len(set(got.values())) == 4
    few = {r.gid for r in outliers.groups(spark.createDataFrame(rows[-2:], "lang string, source string"), 5).collect()}
    assert few == {None}


def test_few_repeated_and_empty(spark):
    """Nulls, copies, clashing names and tables too small for an estimate."""
    same = "some words of a plain document that all of its copies have in common, and no more than that."
    rows = [(k % 3, same, "xx", "s", *MORE) for k in range(200)] + [(None, None, None, None, *MORE), (7, "", "xx", "s", *MORE), (8, "long " * 200_000, "xx", "s", *MORE)]
    got = outliers.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 203
    assert all(r.kept and r.distance == 0 for r in got if r.text == same)
    assert all(r.base_failed and not r.kept and r.distance is None for r in got if r.text != same)
    few = outliers.judge(spark.createDataFrame(rows[:5], DOCS)).collect()
    assert all(r.kept and r.distance is None for r in few)
    assert outliers.judge(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_as_sql(spark, sf):
    assert_same(QUERIES["op11_outliers"](spark, sf), ORACLE_SQL["op11_outliers"], sf)
