"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import bpe, mixing, neardup, substrings
from verdigris.llm.queries import QUALITY_THRESHOLD, quality_scores
from verdigris.llm.store import release, small, stored


#: Columns that operators read; all others are out of their way while they run.
_READ = ("doc_id", "text", "source")


def _shielded(docs: DataFrame) -> DataFrame:
    """``docs`` with every column that no operator reads under a name that no operator uses."""
    return docs.select([F.col(f"`{c}`") if c in _READ else F.col(f"`{c}`").alias(f"_own_{k}") for k, c in enumerate(docs.columns)])


def _shaped(df: DataFrame, like: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of ``like`` from a result on its shielded form; n_chars counted again if texts changed."""
    own = [F.col(c if c in _READ else f"_own_{k}").alias(c) for k, c in enumerate(like.columns)]
    out = df.select(own)
    return out.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType)) if changed and "n_chars" in like.columns else out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from labelled documents of the input.

    Every row is judged by its whole text alone: repeated rows have one fate, null and empty texts the
    one of the bias, and a null id is no label's. Columns stay as they are, whatever their names.
    """
    own = _shielded(docs)
    scored = quality_scores(own, spark.read.parquet(f"{sf_dir}/labels.parquet"), own)
    return _shaped(scored.filter(F.col("score") >= QUALITY_THRESHOLD), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, of similarity 0.8 and more: that of the smallest id.

    Where rows share an id or have none, all are compared by numbers of their own; one without an id gives
    way to one with. Texts without words are near nothing, but rows that repeat an id and text are one.
    Very long texts are compared whole. Columns stay as they are, whatever their names.
    """
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL OR n > 1").isEmpty():
        return _numbered_near_dedup(docs)
    groups = neardup.near_duplicates(docs.select("doc_id", "text"), percent=80)
    drop = stored(groups.filter("NOT kept").select("doc_id"), "pipeline-drop")
    return docs.join(small(drop), "doc_id", "left_anti").select(docs.columns)


def _numbered_near_dedup(docs: DataFrame) -> DataFrame:
    rows = stored(_shielded(docs).withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = neardup.near_duplicates(rows.select("_row", "text"), id_col="_row", percent=80).select("_row", "component_id", (F.col("n_shingles") == 0).alias("_empty"))
    named = groups.join(rows.select("_row", "doc_id", F.sha2("text", 256).alias("_sha")), "_row")
    group = [F.when(~F.col("_empty"), F.col("component_id")).alias("_a"), F.when(F.col("_empty"), F.col("doc_id")).alias("_b"), F.when(F.col("_empty"), F.col("_sha")).alias("_c")]
    first = stored(named.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_sha", "_row")).alias("first")).select("first._row"), "pipeline-first")
    drop = stored(rows.select("_row").join(first, "_row", "left_anti"), "pipeline-drop")
    return _shaped(rows.join(small(drop), "_row", "left_anti"), docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that start earlier in the corpus; a text that loses none stays to the letter, null included.

    Rows without an id lose nothing and take nothing; rows that repeat an id and text start at one place
    and have one fate. Texts of any length are read whole. Columns but text and n_chars stay as they are.
    """
    found = substrings.remove_repeats(_shielded(docs))
    return _shaped(found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))), docs, changed=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target: a row for every time that a document is taken, the copy in which a budget ends being cut there.

    Documents without words, null and empty texts among them, are in no mix. A null source is one of its
    own, ids may be null, and repeated rows at a budget's end share it. Columns but text and n_chars stay as they are.
    """
    return _shaped(mixing.copies(mixing.mix(_shielded(docs))), docs, changed=True)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they decode to, as digests: a row for every row, with its doc_id, lang and source.

    Null and empty texts have no ids; other columns are left out, whatever their names.
    """
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern, keep=["doc_id", "lang", "source"])
    back = bpe.decode(ids, ranks, pattern)
    return back.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: The classifier has no SQL form; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one is written."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
        before = docs
    return docs
