"""Versioned documents: a table of buckets whose snapshots are switched at once.

A version is a manifest that names one Parquet folder for each bucket of keys. A writer puts the buckets that it changes into new
folders and then creates the next manifest, which either is there whole or isn't: readers go by the last manifest, so they see a
finished version or the one before, and a writer that dies leaves folders that no manifest names. Of two writers of one version the
second finds the manifest taken and fails without having changed anything.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has made the version first."""


def _files(spark: SparkSession, path: str):  # noqa: ANN202  a JVM object
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


class Versions:
    """The table in a folder, with rows of ``schema`` in ``buckets`` by a hash of the key."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_versions/{version:09d}.json"

    def versions(self) -> list[int]:
        files, place = _files(self.spark, f"{self.path}/_versions")
        if not files.exists(place):
            return []
        names = (s.getPath().getName() for s in files.listStatus(place))
        return sorted(int(n[:9]) for n in names if n.endswith(".json") and n[:9].isdigit())

    def _folders(self, version: int | None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        if version is None:
            return {}
        text = self.spark.read.option("wholetext", True).text(self._manifest(version)).first().value
        return {int(k): v for k, v in json.loads(text)["buckets"].items()}

    def _bucket(self):  # noqa: ANN202
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The last version's rows, or those of an earlier one; a table without versions is empty."""
        if version is None:
            version = max(self.versions(), default=None)
        return self._read(list(self._folders(version).values()))

    def update(self, new: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """The next version, its number given back: ``change`` of the old rows and the new ones, in buckets that new keys fall into; other buckets
        stay as they are and are neither read nor written. ``change`` gives rows of these buckets' keys only."""
        last = max(self.versions(), default=None)
        folders = self._folders(last)
        touched = [r.b for r in new.select(self._bucket().alias("b")).distinct().collect()]  # numbers of buckets
        old = self._read([folders[b] for b in touched if b in folders])
        changed = change(old, new).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        folder = f"data-{uuid.uuid4().hex}"
        # a column of another name than any of the rows', for a folder of each bucket
        part = "_bucket"
        while part in self.schema.names:
            part += "_"
        changed.withColumn(part, self._bucket()).repartition(len(touched) or 1, part).write.partitionBy(part).parquet(f"{self.path}/{folder}")
        files, place = _files(self.spark, f"{self.path}/{folder}")
        written = {int(s.getPath().getName().split("=")[1]): f"{folder}/{s.getPath().getName()}" for s in files.listStatus(place) if "=" in s.getPath().getName()}
        if set(written) - set(touched):
            raise ValueError("a change gave rows of other buckets than those of the new keys")
        kept = {b: f for b, f in folders.items() if b not in touched}
        version = 0 if last is None else last + 1
        self._commit(version, kept | written)
        return version

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        """Writes the manifest under a name of its own and gives it its number, if no other has it."""
        text = json.dumps({"buckets": {str(k): v for k, v in sorted(folders.items())}})
        files, draft = _files(self.spark, f"{self.path}/_versions/.draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        _, final = _files(self.spark, self._manifest(version))
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    def clean(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` manifests, and folders that none of these names, such as those of writers that died; to be
        called while nobody writes. Gives back how many folders went."""
        kept = self.versions()[-keep:]
        named = {f.split("/")[0] for v in kept for f in self._folders(v).values()}
        for v in self.versions()[:-keep]:
            files, place = _files(self.spark, self._manifest(v))
            files.delete(place, False)
        files, place = _files(self.spark, self.path)
        gone = [s.getPath() for s in files.listStatus(place) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in named]
        for folder in gone:
            files.delete(folder, True)
        return len(gone)
