import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from verdigris.llm import bpe, queries, words

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_random_texts_as_tiktoken(both):
    ours, theirs = both
    rng = random.Random(5)
    letters = list(" \n\t \x1c aaeé'sS1²٣!.,　漢字don't") + ["the ", "  ", "\u0000", "😀"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 700 + "!" * 900, "x y" * 400, "", "é" * 999]
    for text, raw in zip(texts, ours.encode(texts), strict=True):
        assert ids(raw) == theirs.encode_ordinary(text), repr(text)
        assert ours.decode(raw) == text.encode()


def test_tiles_agree_with_rows(both):
    ours, theirs = both
    rng = random.Random(6)
    for _ in range(200):
        piece = "".join(rng.choice("abcdethinger 0") for _ in range(rng.randint(2, 200))).encode()
        if piece not in ours.ranks:
            assert ours.merge_tiles(piece).tolist() == ours.encode_pieces([piece])[1].tolist()
    for n in (257, 1024, 5000):
        piece = "".join(rng.choice("abcdethinger") for _ in range(n))
        assert ours.merge_tiles(piece.encode()).tolist() == theirs.encode_ordinary(piece)


def test_pieces_are_the_matches_of_the_pattern(both):
    ours, _ = both
    rng = random.Random(9)
    letters = list(" \n\t' ' '\x1c\x85\u00a0\u3000stmdrevlSTL1²٣!.漢é😀")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    data, offsets = words.content(pa.array(texts))
    a, b, bounds = ours.split(data, offsets)
    for i, text in enumerate(texts):
        got = [data[x:y].tobytes().decode() for x, y in zip(a[bounds[i] : bounds[i + 1]], b[bounds[i] : bounds[i + 1]], strict=True)]
        assert got == ours.pattern.findall(text), repr(text)


def test_another_pattern(both):
    ours, _ = both
    pattern = r"\d+|\w+| +|."
    other, theirs = bpe.ByteBpe(ours.ranks, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ours.ranks, special_tokens={})
    texts = ["abc 12 é漢 x", "", None, "  two, three\tfour"]
    for text, raw in zip(texts, other.encode(texts), strict=True):
        assert ids(raw) == theirs.encode_ordinary(text or "")


def test_cache_overflow(both, monkeypatch):
    ours, theirs = both
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(ours, "remembered", bpe.Remembered())
    texts = [f"word{i} other{i * 7} " + "z" * 80 for i in range(50)]
    for a in range(0, 50, 7):
        for text, raw in zip(texts[a : a + 7], ours.encode(texts[a : a + 7]), strict=False):
            assert ids(raw) == theirs.encode_ordinary(text)


def test_query(spark, both):
    _, theirs = both
    got = {r.doc_id: r for r in queries.op1_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = theirs.encode_ordinary(d.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in want)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(raw).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_nulls_repeats_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (1, "hi there", "c"), (1, "hi there", "c")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.text or "", len(r.ids), bytes(r.decoded).decode()) for r in out.collect()) == [("", 0, ""), ("", 0, ""), ("hi there", 8, "hi there"), ("hi there", 8, "hi there")]
    assert bpe.encode(df.filter(F.lit(False)), PATH, public_tokenizers.PATTERN).count() == 0
