"""Views of the driver's tables that stand in for benchmark inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.tables import table


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, prompt_role, prediction, reference): each assistant turn against the turn before."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("prompt_role"), F.col("text").alias("reference"))
    return answers.join(before, ["conv_id", "turn"])


PAIRS = """pairs AS (SELECT a.conv_id, a.turn, b.role AS prompt_role, a.text AS prediction, b.text AS reference
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant')"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, task, id, score): mean discount by supplier nation, return flag and brand."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(parts, lines.l_partkey == parts.p_partkey)
    return joined.groupBy(F.col("s_nationkey").alias("model"), F.col("l_returnflag").alias("task"), F.col("p_brand").alias("id")).agg(F.round(F.avg("l_discount"), 8).alias("score"))


MATRIX = """matrix AS (SELECT s_nationkey AS model, l_returnflag AS task, p_brand AS id, round(avg(l_discount), 8) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type, a, b): two ordinal ratings from 0 to 5."""
    events = table(spark, sf_dir, "events")
    a = F.least(F.lit(5), F.floor(F.col("value") / 20)).cast("int")
    b = (F.regexp_extract("props", "([0-9]+)", 1).try_cast("int") % 6).cast("int")
    return events.select("event_id", "user_id", "event_type", a.alias("a"), b.alias("b"))


RATERS = """raters AS (SELECT event_id, user_id, event_type, least(5, floor(value / 20))::INTEGER AS a,
  (TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 6)::INTEGER AS b FROM events)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, metric, judge, tier): documents with labels as judged items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    number = F.regexp_extract("source", "([0-9]+)", 1).try_cast("int")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", "n_chars", (F.col("n_chars") % 1000 / 1000.0).alias("metric"), (F.col("quality") * 3 + F.col("toxic") * 2).alias("judge"), F.when(number < 3, 3).when(number < 8, 2).otherwise(1).alias("tier"))


LABELLED = """labelled AS (SELECT d.doc_id, lang, source, n_chars, n_chars % 1000 / 1000.0 AS metric, quality * 3 + toxic * 2 AS judge,
  CASE WHEN TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) < 3 THEN 3 WHEN TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) < 8 THEN 2 ELSE 1 END AS tier
  FROM documents d JOIN labels USING (doc_id))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, version, question, is_correct, prompt_chars, output_chars, error): events as answers to prompts of three versions."""
    versions = F.element_at(F.array(F.lit("modern"), F.lit("english"), F.lit("classical")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), versions.alias("version"), F.floor(F.col("event_id") / 3).cast("long").alias("question"), (F.col("value") > 40).alias("is_correct"), (F.col("user_id") % 97 + 20).alias("prompt_chars"), (F.col("event_id") % 53 + 5).alias("output_chars"), F.when(F.col("event_id") % 29 == 0, "timeout").alias("error"))


RUNS = """runs AS (SELECT event_type AS model, ['modern', 'english', 'classical'][(event_id % 3 + 1)::INTEGER] AS version, event_id // 3 AS question,
  value > 40 AS is_correct, user_id % 97 + 20 AS prompt_chars, event_id % 53 + 5 AS output_chars, CASE WHEN event_id % 29 = 0 THEN 'timeout' END AS error FROM events)"""
