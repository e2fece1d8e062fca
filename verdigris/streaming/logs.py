"""Append-only logs: resume, compaction and a stream into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.samples import last_wins


def pending(work: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key the log doesn't have."""
    return work.join(log.select(*keys).distinct(), keys, "left_anti")


def compacted(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return last_wins(log, keys, seq)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def stream_to_log(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends each micro-batch's new keys to a Parquet log, once.

    The stream's state holds the keys that it has seen, in RocksDB on the executors and in the checkpoint, so a batch costs what it
    brings, however long the log has become. Keys that the log had before the stream first ran are written down once, beside the checkpoint.
    A batch has a folder of its own, batch=number, which it overwrites when it is repeated after a failure: nothing is there twice.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = f"{checkpoint}-known"
    if not _exists(spark, f"{known}/_SUCCESS"):
        before = spark.read.parquet(path).select(*keys).distinct() if _exists(spark, path) else stream.sparkSession.createDataFrame([], stream.select(*keys).schema)
        before.write.mode("overwrite").parquet(known)

    def write(batch: DataFrame, number: int) -> None:
        fresh = pending(batch, batch.sparkSession.read.parquet(known), keys)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.dropDuplicates(keys).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
