import hashlib
import random
import re

import pytest

from verdigris.llm import queries, store, substrings
from verdigris.llm.automaton import SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, n=20):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            window = tuple(w[k : k + n])
            if window in seen:
                gone[k : k + n] = [True] * n
            seen.add(window)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_automaton_as_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        parts = [[rng.randint(0, 2) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 5))]
        for window in (1, 2, 4):
            a, first, begin = SuffixAutomaton(), {}, []
            for p in parts:
                begin.append(a.added)
                for n in range(1, len(p) + 1):
                    for k in range(len(p) - n + 1):
                        first.setdefault(tuple(p[k : k + n]), a.added + k + n - 1)
                a.add(p)
            for p in [*parts, [rng.randint(0, 3) for _ in range(20)]]:
                assert a.matches(p, window) == [first.get(tuple(p[k : k + window]), -1) for k in range(len(p) - window + 1)]
                assert a.whole(p) == first.get(tuple(p), -1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_as_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    want = {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in brute(docs).items()}
    rows = queries.op9_substrings(spark, f"/root/testdata/{sf}").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and len(rows) == len(docs)


@pytest.mark.parametrize("hot", [2, 2000])
def test_random_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(hot)
    passages = [[f"p{j}_{k}" for k in range(rng.randint(5, 60))] for j in range(12)] + [["la"] * 45, ["x", "y"] * 30, ["common"] * 8 + ["line"] * 4]
    docs = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += [f"r{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 15))]
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            text += p[a : a + rng.randint(1, len(p))]
        docs.append((rng.randint(-500, 10**6), " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df).collect()}
    assert got == brute(docs)


def test_edges(spark):
    line = " ".join(f"w{k}" for k in range(25))
    rows = [(1, line, "a"), (1, line, "a"), (2, f"{line}\n\t{line}", None), (None, line, "n"), (4, None, "x"), (5, "", "y"), (6, "a b", "z"), (7, "q " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").selectExpr("*", "1 as _n", "2 as id")
    out = substrings.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "_n", "id", "n_words", "n_removed", "kept"]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, len(r.kept)) for r in out.collect())
    assert got == sorted([(1, 25, 0, len(line)), (1, 25, 0, len(line)), (2, 50, 50, 0), (0, 25, 0, len(line)), (4, 0, 0, 0), (5, 0, 0, 0), (6, 2, 0, 3), (7, 30000, 29999, 1)])
    assert substrings.remove_repeats(df.limit(0)).count() == 0


SHARDS = "key long, part long, salt long, streamed boolean, piece long, copies int, id long, start int, body binary"


def test_what_automata_say(spark):
    """A shard's shorter range doesn't cut an earlier shard's longer one; streamed pieces are no reference; a whole piece may be first inside another."""
    body = lambda *words: b"".join(w.to_bytes(8, "little") for w in words)
    long = tuple(range(10))
    rows = [(1, 0, 0, False, 11, 0, 1, 0, body(*long)), (1, 0, 0, False, 12, 1, 5, 100, body(*long[3:8])), (1, 0, 0, True, 13, 0, 0, 7, body(*long)), (1, 0, 0, True, 13, 0, 6, 0, body(50, *long[2:6], 51)), (2, 0, 0, False, 21, 0, 2, 0, body(7, 8, 9)), (2, 0, 0, False, 22, 2, 5, 102, body(60, 7, 8, 9))]
    df = spark.createDataFrame(rows, SHARDS).coalesce(1).sortWithinPartitions("key", "part", "salt", "streamed", "id", "start")
    got = {tuple(r) for r in substrings._decided(df, 3).collect()}
    assert got == {(None, None, 5, 100, 105, 1, 3), (1, 12, None, 1, 5, 1, 3), (None, None, 6, 1, 5, 1, 2), (None, None, 5, 103, 106, 2, 0), (2, 22, None, 2, 4, 5, 102)}


def test_spans_are_maximal(spark):
    rows = [(1, 0, 20, 0, 5), (1, 10, 30, 0, 15), (1, 30, 50, 0, 35), (1, 51, 71, 0, 56), (1, 0, 20, 0, 6), (2, 0, 20, 0, 5)]
    got = sorted(tuple(r) for r in substrings._spans(spark.createDataFrame(rows, substrings.SPANS).repartition(3)).collect())
    assert got == [(1, 0, 20, 0, 6), (1, 0, 50, 0, 5), (1, 51, 71, 0, 56), (2, 0, 20, 0, 5)]


def test_spans_without_equal_words_stay(spark):
    """Hashes that collide remove nothing: the words of both places are compared."""
    texts = spark.createDataFrame([(1, "a b c d"), (2, "x a b y")], "id long, text string")
    proofs = {(r.first_begin, r.size): bytes(r.proof) for r in substrings._proofs(texts, spark.createDataFrame([(2, 1, 3, 1, 0), (2, 0, 2, 1, 1)], substrings.SPANS)).collect()}
    spans = [[(1, 3, proofs[0, 2]), (0, 2, proofs[1, 2])]]
    df = spark.createDataFrame([(2, "x a b y", spans[0])], "id long, text string, _spans array<struct<begin:int,end:int,proof:binary>>")
    assert [(r.n_removed, r.kept) for r in substrings._kept(df, "text", True).collect()] == [(2, "x y")]


@pytest.mark.parametrize("copies", [1, 4])
def test_words_that_share_half_a_hash(spark, copies):
    """These two words have 32 bits of their hashes in common. What surrounds them is a repeat, they are not; and a second place that has the same word is found behind the first that hasn't."""
    before, after = (" ".join(f"{c}{k}" for k in range(25)) for c in "ab")
    docs = [(1, f"{before} w266449 {after}")] + [(2 + k, f"{before} w324832 {after}") for k in range(copies)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert got[2] == (51, 50, "w324832") and all(got[3 + k][1] == 51 for k in range(copies - 1))


def test_one_id_with_two_texts(spark):
    line = " ".join(f"w{k}" for k in range(30))
    rows = [(1, line), (2, f"a b c {line}"), (2, f"{line} and more")]
    got = sorted((r.doc_id, r.n_removed, r.kept) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, line), (2, 30, "a b c"), (2, 30, "and more")]


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(store, "MOST_BYTES", -1)
    monkeypatch.setattr(substrings, "HOT", 3)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in brute(docs).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substrings(spark, "/root/testdata/sf0.001").collect()} == want
