"""Readers of the driver's star-schema tables, and what every operator needs of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` under ``sf_dir`` (a local or remote folder); column pruning is left to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; only a session with a local master may have none set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="verdigris-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """With a broadcast hint if a count shows at most ``most_rows`` rows, else as it is: Spark then joins by sorting."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
