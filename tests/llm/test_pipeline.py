import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_neardup import brute as brute_groups
from tests.llm.test_substrings import brute as brute_repeats
from tests.llm.util import duck
from verdigris.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns(steps):
    for df in steps[:5]:
        assert df.dtypes == steps[0].dtypes
        assert all(r.n_chars == len(r.text or "") for r in df.collect())


def test_quality(spark, steps):
    scores = {r.doc_id: r.predicted for r in queries.op3_quality(spark, SF).collect()}
    assert Counter(steps[1].collect()) == Counter(r for r in steps[0].collect() if scores[r.doc_id])


def test_near_dedup_from_0_80(spark, steps):
    """Pairs of 0.80 to 0.85 are near-duplicates too; one of 0.79 isn't."""
    rows = steps[1].collect()
    want = brute_groups([(r.doc_id, r.text) for r in rows], 80)
    assert Counter(steps[2].collect()) == Counter(r for r in rows if want[r.doc_id][1] == r.doc_id)
    whole = {c: [f"{c}{i}" for i in range(104)] for c in "uvw"}  # 100 shingles each; of their first n words, n - 4
    texts = [whole["u"], whole["u"][:86], whole["v"], whole["v"][:84], whole["w"], whole["w"][:83]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()) == [0, 2, 4, 5]


def test_near_dedup_of_shared_and_missing_ids(spark):
    same, other, lone = "p q r s t u", "a b c d e f", "k l m n o p"
    docs = [(3, same), (3, same), (4, same), (None, same), (None, same), (None, other), (None, other), (5, same), (5, lone), (7, None), (7, None), (7, ""), (8, ""), (None, ""), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, corpus_pipeline.near_dedup_stage(spark, df, SF).collect()))
    assert got == Counter([(3, same), (None, other), (5, lone), (7, None), (7, ""), (8, ""), (None, "")])
    assert corpus_pipeline.near_dedup_stage(spark, df.limit(0), SF).count() == 0


def test_substrings(steps):
    rows = steps[2].collect()
    want = brute_repeats([(r.doc_id, r.text) for r in rows])
    assert {r.doc_id: r.text for r in steps[3].collect()} == {r.doc_id: want[r.doc_id][2] if want[r.doc_id][1] else r.text for r in rows}


def test_mixing(steps, tmp_path):
    steps[3].toPandas().to_parquet(tmp_path / "documents.parquet")
    sql = queries.ORACLE_SQL["op6_mixing"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")
    names, rows = duck(sql, SF)
    taken = {r[names.index("doc_id")]: (r[names.index("taken")], r[names.index("size")]) for r in rows}
    texts, found = {r.doc_id: r.text for r in steps[3].collect()}, {}
    for r in steps[4].collect():
        found.setdefault(r.doc_id, []).append(r.text)
    assert set(found) == {i for i, (n, _) in taken.items() if n}
    for i, copies in found.items():
        n, size = taken[i]
        assert sorted(len(c.split()) for c in copies) == sorted([size] * (n // size) + [n % size] * (n % size > 0))
        assert all(c == texts[i] or texts[i].split()[: len(c.split())] == c.split() for c in copies)


def test_encoding(steps):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(text):
        ids = enc.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in steps[5].collect()) == Counter((r.doc_id, *want(r.text)) for r in steps[4].collect())


CLASHING = ["score", "n_words", "n_removed", "kept", "size", "source_size", "target", "taken", "ids", "decoded", "_row", "_id", "id", "component_id"]


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and columns named like the operators' own."""
    passage = " ".join(f"w{k}" for k in range(40))
    long = " ".join(f"v{k % 997}x{k}" for k in range(60_000))
    texts = [(1, "plain words of a plain text", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, f"one {passage} two", "en", "a"), (5, f"three {passage} four five", "fr", None), (6, long, "en", "b"), (6, long, "en", "b"), (None, "no id at all here", None, None), (None, None, None, None), (8, " \t\n", "en", "a"), (9, "漢字 " * 3000, "xx", "b")]
    rows = [(i, t, lang, source, None if t is None else len(t), *[f"{c}-{k}" if k % 3 else None for c in CLASHING]) for k, (i, t, lang, source) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3)


def test_stages_keep_clashing_columns(spark):
    docs = odd_documents(spark)
    want = Counter(map(tuple, docs.collect()))
    good = corpus_pipeline.quality_stage(spark, docs, SF)
    assert good.columns == docs.columns and not Counter(map(tuple, good.collect())) - want
    kept = Counter(map(tuple, corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()))
    assert not kept - want and sorted(r[0] for r in (want - kept).elements()) == [5, 6]
    cut = corpus_pipeline.substring_stage(spark, docs, SF)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    for r in cut.collect():
        if r.doc_id in (5, 9):
            assert r.text == ("three four five" if r.doc_id == 5 else "漢字") and r.n_chars == len(r.text)
        else:
            assert want[tuple(r)] > 0
    own = {r.doc_id: [tuple(r)[5:] for r in docs.collect() if r.doc_id == r.doc_id] for r in docs.collect()}
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF).collect()
    assert mixed and {r.doc_id for r in mixed} <= {1, 4, 5, 6, None, 9}
    assert all(tuple(r)[5:] in own[r.doc_id] and r.n_chars == len(r.text) for r in mixed)
    encoded = corpus_pipeline.encoding_stage(spark, docs, SF).collect()
    assert len(encoded) == docs.count() and sum(r.n_tokens == 0 for r in encoded) == 3


def test_run_on_odd_documents(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.n_tokens > 0 and len(r.ids_sha256) == 64 for r in rows)


def test_run_and_empty_tables(spark, steps, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
