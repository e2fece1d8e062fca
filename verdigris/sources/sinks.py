"""Writers: overwritten JSON and lines, appended logs, documents updated by task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def document(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones of other keys."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A dry run: (keys..., old, new) of what a write would change."""
    joined = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys, "full_outer")
    return joined.filter(~F.col("old").eqNullSafe(F.col("new")))


def updated_documents(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Model documents (model, base_url, started_at, last_updated_at, tasks) after a run's (model, base_url, tasks map).

    Tasks of the run replace those of the same name, others stay. A document that is there keeps its start and gets
    ``now`` as its last update; one that isn't, or couldn't be read (no tasks, as of a corrupt file), starts now.
    """
    there = old.filter(F.col("tasks").isNotNull()).select("model", F.col("started_at").alias("_started"), F.col("tasks").alias("_tasks"))
    joined = new.join(there, "model", "left")
    found = F.col("_tasks").isNotNull()
    kept = F.map_filter("_tasks", lambda k, _: ~F.array_contains(F.map_keys("tasks"), k))
    fresh = joined.select("model", "base_url", F.when(found, F.col("_started")).otherwise(now).alias("started_at"), F.when(found, F.lit(now)).alias("last_updated_at"), F.when(found, F.map_concat(kept, "tasks")).otherwise(F.col("tasks")).alias("tasks"))
    rest = old.join(new.select("model").distinct(), "model", "left_anti").select(fresh.columns)
    return fresh.unionByName(rest)


def remembered(work: DataFrame, path: str, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make`` of the work whose keys a Parquet memo doesn't have yet, appended to it; then the memo's rows of all the work."""
    spark = work.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    todo = work.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if there else work
    if not there or not todo.isEmpty():
        make(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(work.select(*keys).distinct(), keys, "left_semi")
