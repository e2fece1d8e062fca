import random

import pytest

from verdigris.operators import containment, items


def by_hand(texts, parts):
    out = {}
    for doc, text in texts:
        for p in {p for p in parts if p}:
            if n := (text or "").count(p):  # leftmost, not overlapping
                out[doc, p] = n
    return out


def made(seed):
    rng = random.Random(seed)
    letters = "ab漢é𝄞 \n"
    texts = [(k, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60, 300])))) for k in range(120)] + [(500, None), (501, "a" * 5000), (502, "ab" * 100_000)]
    parts = ["a", "aa", "aaa", "ab", "abab", "漢", "é漢", "𝄞", "\n", "", None, "x", "a" * 4999, "ba" * 70, "a" * 5001]
    parts += [t[i : i + n] for _, t in texts[:120] for i, n in [(rng.randrange(max(len(t), 1)), rng.randint(1, 20))]]
    return texts, parts


@pytest.mark.parametrize("seed", [1, 2])
def test_as_count(spark, seed):
    texts, parts = made(seed)
    corpus = spark.createDataFrame(texts, "doc long, text string").repartition(3)
    table = spark.createDataFrame([(p,) for p in parts], "part string")
    got = {(r.doc, r.part): r.hits for r in containment.occurrences(corpus, table, "part", "text", ["doc"]).collect()}
    assert got == by_hand(texts, parts)


def test_joined_by_sorting_and_full_filter(spark, monkeypatch):
    """The filter only saves work: with nearly all of its few bits set, and without a broadcast, counts are the same."""
    texts, parts = made(3)
    corpus = spark.createDataFrame(texts, "doc long, text string")
    table = spark.createDataFrame([(p,) for p in parts], "part string")
    monkeypatch.setattr(containment, "MOST_BITS", 6)
    monkeypatch.setattr(containment, "small", lambda df: df)
    monkeypatch.setattr(containment, "SLICE", 100)
    got = {(r.doc, r.part): r.hits for r in containment.occurrences(corpus, table, "part", "text", ["doc"]).collect()}
    assert got == by_hand(texts, parts)


def test_rows_of_a_corpus_stay_apart(spark):
    """Rows without kept columns, or with equal ones, are texts of their own: 'aaa' twice has two occurrences of 'aa', not three."""
    corpus = spark.createDataFrame([("aaa",), ("aaa",)], "text string")
    got = containment.occurrences(corpus, spark.createDataFrame([("aa",)], "p string"), "p", "text").collect()
    assert [r.hits for r in got] == [1, 1]
    hits = items.shingle_hits(spark.createDataFrame([(1, "aa"), (2, ""), (3, "zz")], "id int, p string"), corpus, "id", "p", "text").collect()
    assert {r.id: r.hits for r in hits} == {1: 2, 2: 0, 3: 0}


def test_nothing(spark):
    corpus = spark.createDataFrame([(1, "abc")], "doc int, text string")
    none = spark.createDataFrame([("",), (None,)], "p string")
    assert containment.occurrences(corpus, none, "p", "text", ["doc"]).count() == 0
    assert containment.occurrences(corpus.filter("doc > 1"), spark.createDataFrame([("a",)], "p string"), "p", "text", ["doc"]).count() == 0


def test_many_parts(spark):
    """Fifty thousand parts, of which a filter of their size lets few strangers pass."""
    parts = spark.range(50_000).selectExpr("concat('k', id, '-', id * 7 % 1000) AS p")
    corpus = spark.range(300).selectExpr("id AS doc", "concat('.k', id * 100, '-', id * 700 % 1000, '. none k', id + 60000, '-1') AS text")
    got = containment.occurrences(corpus, parts, "p", "text", ["doc"]).groupBy("doc").count().collect()
    assert len(got) == 300
