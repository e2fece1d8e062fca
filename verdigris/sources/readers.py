"""Readers: JSON lines, nested result documents, seeds, question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.operators.samples import first_wins
from verdigris.schemas import JUDGEMENT, RECORD, RESULT


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType = RECORD, mode: str = "FAILFAST") -> DataFrame:
    """Blank lines are no rows. FAILFAST: one bad line fails; DROPMALFORMED leaves bad lines out."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def judgements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A tolerant append log: bad lines and rows without a score are left out. ``seq`` is file and place, for the last one to win."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"))
    parsed = lines.select(F.from_json("value", JUDGEMENT, {"mode": "PERMISSIVE"}).alias("j"), "seq").select("j.*", "seq")
    return parsed.filter("judge IS NOT NULL AND model IS NOT NULL")


def results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each model's document; names that begin with _ are skipped by the file index, bad documents have a corrupt column and no tasks."""
    schema = T.StructType([*RESULT.fields, T.StructField("_corrupt", T.StringType())])
    docs = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1)
    return docs.withColumn("model", F.coalesce("model", stem)).withColumn("file", F.col("_metadata.file_name"))


def items(docs: DataFrame) -> DataFrame:
    """(model, file, task, ord, id, input, reference, prediction, scores): the items of all documents."""
    tasks = docs.select("model", "file", F.explode("tasks").alias("task", "t"))
    return tasks.select("model", "file", "task", F.posexplode("t.items").alias("ord", "i")).select("model", "file", "task", "ord", "i.*")


def item_scores(docs: DataFrame) -> DataFrame:
    """(model, task, id, metric, score): the fact table of all statistics."""
    return items(docs).select("model", "task", "id", F.explode("scores").alias("metric", "score"))


def json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def seeds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(idiom, gloss) from lines "idiom | gloss"; comments and blanks are skipped, a gloss may be missing, the first of an idiom counts."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("seq")).filter("value <> '' AND NOT startswith(value, '#')")
    parts = F.split("value", r"\|", 2)
    rows = lines.select(F.trim(parts[0]).alias("idiom"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("gloss"), "seq")
    return first_wins(rows, ["idiom"], "seq").drop("seq")


def questions(tables: dict[str, tuple[DataFrame, int]], order: str, valid: Column) -> DataFrame:
    """So many valid questions of each source; the count is of rows before the check, so bad rows use up places."""
    out = None
    for name, (df, n) in tables.items():
        part = df.orderBy(order).limit(n).filter(valid).withColumn("source_config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
