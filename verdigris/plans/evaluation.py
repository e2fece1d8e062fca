"""A model's run from records to documents: prompts, answers, scores and the results of each task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators.scorers import Scorers, summary
from verdigris.sources.endpoint import Client, Settings, predictions
from verdigris.tables import scratch


def now() -> Column:
    """The time as documents have it."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def answered(records: DataFrame, make_client: Callable[[], Client], scorers: Scorers, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Records (id, task, instruction, input, reference, metadata) with their prediction, scores, error, tokens, asked_at and latency_s, from a table in the shared folder. A failed answer is empty and scored as such."""
    asked = predictions(records.withColumn("_prompt", X.prompt(F.col("instruction"), F.col("input"))), make_client, "_prompt", settings)
    path = scratch(records.sparkSession, "answers")  # a question is asked once, however often its answer is read
    asked.drop("_prompt").write.parquet(path)
    return scorers.score(records.sparkSession.read.parquet(path))


def task_results(rows: DataFrame, model: Column, base_url: Column) -> DataFrame:
    """Documents (model, base_url, tasks) of answered rows: for each task its number of items and errors, the seconds from the first question to the last answer, the means, and the items by id."""
    keyed = rows.select(model.alias("model"), base_url.alias("base_url"), *[c for c in rows.columns if c not in ("model", "base_url")])
    means = summary(keyed, ["model", "task"]).groupBy("model", "task").agg(F.map_from_entries(F.collect_list(F.struct("metric", "mean"))).alias("summary"))
    item = F.struct("id", "input", "reference", "prediction", "scores")
    ended = F.max(F.col("asked_at") + F.col("latency_s"))
    each = keyed.groupBy("model", "base_url", "task").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count("error").cast("int").alias("errors"), F.round(ended - F.min("asked_at"), 2).alias("elapsed_sec"), F.array_sort(F.collect_list(F.struct(F.col("id").alias("o"), item.alias("i"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)).alias("_items"))
    done = each.join(means, ["model", "task"], "left").withColumn("items", F.transform("_items", lambda x: x["i"]))
    result = F.struct("task", "n", "errors", "elapsed_sec", "summary", "items")
    return done.groupBy("model", "base_url").agg(F.map_from_entries(F.collect_list(F.struct("task", result.alias("r")))).alias("tasks"))
