import random
import re

import numpy as np
import pyarrow as pa
import pytest

from verdigris.llm import components, neardup, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, percent=85):
    sets = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        common = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_as_brute_force(spark, sf):
    rows = queries.op10_neardup(spark, f"/root/testdata/{sf}").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chains_and_hot_groups(spark, monkeypatch):
    """Copies of copies drift apart: links must join what no centre sees."""
    monkeypatch.setattr(neardup, "CHUNK", 16)
    rng = random.Random(4)
    docs, base = [], [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    for i in range(150):
        base = list(base)
        base[rng.randrange(len(base))] = f"v{i}"
        docs.append((rng.randint(0, 10**9), " ".join(base)))
    star = [f"s{rng.randint(0, 10**6)}" for _ in range(150)]
    for i in range(150):
        copy = list(star)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"u{i}"
        docs.append((rng.randint(0, 10**9), " ".join(copy)))
    check(spark, docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x " * 5000), (8, "x x x x x"), (9, "x x x x"), (10, "x x x x x y")]
    check(spark, docs)
    df = spark.createDataFrame([(None, "p q r s t u"), (3, "p q r s t u"), (3, "p q r s t u"), (4, "p q r s t u")], "doc_id long, text string").selectExpr("*", "1 as kept", "2 as id")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [((False, 3), 3, True), ((False, 3), 3, True), ((False, 4), 3, False), ((True, 0), None, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85):
        n = int(2000 * share)
        common, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (n, (2000 - n) // 2, (2000 - n) // 2))
        equal = []
        for _ in range(30):
            salt = rng.integers(0, 2**63, dtype=np.uint64)
            s = neardup.sketch(neardup.mix(np.concatenate([common, a, common, b]) ^ salt), np.array([0, len(common) + len(a), 2 * len(common) + len(a) + len(b)]))
            equal.append((s[0] == s[1]).mean())
        assert abs(np.mean(equal) - share) < 0.04
    one, two = (neardup.sketch(rng.integers(0, 2**63, 500, dtype=np.uint64), np.array([0, 500])) for _ in range(2))
    both = np.maximum(one, two)  # registers merge by their maximum
    assert (both >= one).all()


def test_likelihood_keeps_links():
    n = np.array([500])
    assert not neardup.unlikely(np.array([45]), np.array([8]), np.array([7]), n, n, 0.85)[0]
    assert neardup.unlikely(np.array([20]), np.array([20]), np.array([20]), n, n, 0.85)[0]


def test_crowded_buckets_of_a_template(spark, monkeypatch):
    """Rows that share a long template but are not alike, and some among them that are: by rare shingles, as by brute force."""
    monkeypatch.setattr(neardup, "CHUNK", 8)
    rng = random.Random(12)
    template = [f"t{k}" for k in range(150)]
    docs = []
    for i in range(90):
        own = [f"o{i}_{k}" for k in range(rng.choice([25, 40, 80]))]
        docs.append((i, " ".join(template + own)))
    for i in range(12):  # near copies of some of them, and copies of copies
        words = docs[rng.randrange(len(docs))][1].split()
        at = rng.randrange(len(words))
        docs.append((1000 - i, " ".join(words[:at] + [f"n{i}"] + words[at + 1 :])))
    used, by_rare = [], neardup._by_rare_shingles
    monkeypatch.setattr(neardup, "_by_rare_shingles", lambda rows, *rest: (used.append(rows.count()), by_rare(rows, *rest))[1])
    for percent in (80, 85, 95):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, percent=percent).collect()}
        assert got == brute(docs, percent)
    assert used


def test_rare_shingles_miss_no_pair(spark):
    """Any two sets of the similarity meet in a bucket."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(base[a : a + n])) for i, (a, n) in enumerate((rng.randrange(0, 12), rng.randrange(40, 49)) for _ in range(60))] + [(99, "a b")]
    texts = spark.createDataFrame(docs, "id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in docs}
    rows = spark.createDataFrame([(7, i, i, len(sets[i]), b"") for i, _ in docs], "bucket long, id long, component long, n_shingles long, sketch binary")
    meet = {}
    for r in neardup._by_rare_shingles(rows, texts, 80, 5).collect():
        meet.setdefault(r.bucket, set()).add(r.id)
    together = {(a, b) for found in meet.values() for a in found for b in found if a < b}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 100 * len(x & y) >= 80 * len(x | y):
                assert (a, b) in together


def test_components_as_brute_force(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    assert got == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_of_sliced_batches():
    column = pa.array(["q", "a b c d e f", "", None, "A B C D E F"]).slice(1)
    hashes, bounds = neardup.shingles(column)
    assert np.diff(bounds).tolist() == [2, 0, 0, 2] and (hashes[:2] == hashes[2:]).all()
