"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session with a local master, which has one machine, gets a
    temporary one where none is set; any other must name it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="verdigris-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later jobs, and tasks that are
    repeated after an executor is lost, start from the files."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._stored_at = path
    _made.append((spark, path))
    return again


_made: list[tuple[SparkSession, str]] = []


def clean() -> None:
    """Deletes all that this driver has stored and not released: to be called when results, which read some of it, are written."""
    while _made:
        _delete(*_made.pop())


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read any more; others among ``tables`` are left alone."""
    for df in tables:
        if (path := getattr(df, "_stored_at", None)) is not None:
            _delete(df.sparkSession, path)
            _made.remove((df.sparkSession, path))


#: Bytes up to which a table is broadcast.
MOST_BYTES = 48 << 20


def small(df: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if its rows, which are counted and measured, have MOST_BYTES at most, else as it
    is: Spark then joins by sorting, and splits partitions of hot keys."""
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in plain):
        return df
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f not in plain]
    sizes = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(texts)]).first()
    total = sizes.n * (16 + 8 * len(df.columns)) + sum(s or 0 for s in sizes[1:])
    return F.broadcast(df) if total <= MOST_BYTES else df


def least_hashed(df: DataFrame, keys: list[str], most_rows: int, by: str | None = None, size: str | None = None, most_size: int = 0) -> DataFrame:
    """About ``most_rows`` rows of least hash of the first key, never more: a bounded sample that reruns repeat.

    A count sets a threshold on the hash, so that no task holds or sends more than its share of
    twice that number; without it every task would send its own ``most_rows``. ``by``: so many rows of
    each value of that column. ``size``: of the chosen rows, in the order of the hash, only those stay with
    which the sum of that column is at most ``most_size``; rows of over an eighth of it aren't chosen, so that one can't take the place of all.
    """
    if size is not None:
        df = df.filter(F.col(size) <= most_size // 8)
    hashed = F.xxhash64(keys[0])
    if by is None:
        total = df.count()
        if total > 2 * most_rows:
            df = df.filter(hashed < int(-(2**63) + 2**64 * (2 * most_rows / total)))
        chosen = df.orderBy(hashed, *keys).limit(most_rows)
    else:
        totals = stored(df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_total")), "sample-totals")
        below = df.join(small(totals), F.col(by).eqNullSafe(F.col("_by"))).filter((F.col("_total") <= 2 * most_rows) | (hashed < -(2.0**63) + 2.0**64 * (2 * most_rows / F.col("_total"))))
        nth = Window.partitionBy("_by").orderBy(hashed, *keys)
        chosen = below.withColumn("_nth", F.row_number().over(nth)).filter(F.col("_nth") <= most_rows).drop("_by", "_total", "_nth")
    if size is None:
        return chosen
    chosen = stored(chosen, "sample")
    so_far = Window.orderBy(hashed, *keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of the sample's few rows
    return chosen.withColumn("_so_far", F.sum(size).over(so_far)).filter(F.col("_so_far") <= most_size).drop("_so_far")
