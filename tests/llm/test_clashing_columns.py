"""Operators on tables whose other columns have names that operators use themselves."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from verdigris.llm import bpe, conversations, extraction, filters, language, media, mixing, mtree, neardup, outliers, quality, substrings, warc

CLASHING = ["id", "_id", "_n", "_spans", "_text", "_lang", "_doc", "_label", "_words", "_bytes", "_mix_id", "_mix_size", "_mix_key", "_copy", "own_0", "n", "key", "anchor", "place", "part", "mask", "first", "gid", "d", "x0", "_one", "row", "copy", "whole"]
TEXT = "Some plain words of a document that is here more than once, so that it has near and exact copies and repeats in the table. "


def clashing(df):
    return df.select("*", *[F.lit(f"c{k}").alias(c) for k, c in enumerate(CLASHING)])


def ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def languages(docs, labels):
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return language.predict(docs, language.fit(docs, vocabulary), vocabulary)


OPERATORS = {
    "bpe": lambda docs, labels: bpe.decode(bpe.encode(docs, *ranks()), *ranks()),
    "quality": lambda docs, labels: quality.score(docs, quality.fit(docs, labels)),
    "media": lambda docs, labels: media.read_payload(media.media_info(media.store_text(docs))),
    "mixing": lambda docs, labels: mixing.copies(mixing.mix(docs)),
    "mixing, ids only": lambda docs, labels: mixing.mix(docs, keep=["doc_id"]),
    "language": languages,
    "substrings": lambda docs, labels: substrings.remove_repeats(docs),
    "neardup": lambda docs, labels: neardup.near_duplicates(docs),
    "outliers": lambda docs, labels: outliers.judge(docs, least=5),
    "filters": lambda docs, labels: filters.audit(docs, labels),
    "extraction": lambda docs, labels: extraction.extract(docs.withColumnsRenamed({"doc_id": "page_id", "text": "html"}), extraction.fit(docs.withColumnsRenamed({"doc_id": "page_id", "text": "html"}), sample=5)),
    "warc": lambda docs, labels: warc.read_archives(warc.write_archives(docs.withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"}))),
    "conversations": lambda docs, labels: conversations.repair(docs.withColumnsRenamed({"doc_id": "conv_id", "lang": "role"}).withColumn("turn", F.lit(1).cast("long"))),
    "mtree": lambda docs, labels: mtree.top_k(docs.withColumnsRenamed({"doc_id": "vec_id"}).withColumn("embedding", F.array(F.lit(0.5).cast("float"), F.lit(0.25).cast("float"))), docs.withColumnsRenamed({"doc_id": "vec_id"}).withColumn("embedding", F.array(F.lit(0.5).cast("float"), F.lit(0.25).cast("float"))).filter("vec_id < 3")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names_are_not_in_the_way(spark, name):
    rows = [(k, TEXT * (1 + k % 3) + f"w{k % 5}", ("en", "de")[k % 2], "s") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    plain, odd = OPERATORS[name](docs, labels), OPERATORS[name](clashing(docs), clashing(labels))
    columns = [c for c in plain.columns if c in odd.columns and c not in CLASHING]
    assert {c for c in plain.columns if c not in CLASHING} <= set(odd.columns)
    assert sorted(map(repr, odd.select(columns).collect())) == sorted(map(repr, plain.select(columns).collect()))
