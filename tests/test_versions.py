import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.sources import sinks
from verdigris.sources.versions import Conflict, Versions

SCHEMA = T.StructType([T.StructField("model", T.StringType()), T.StructField("n", T.LongType()), T.StructField("_bucket", T.StringType())])


def rows(spark, *values):
    return spark.createDataFrame([(m, n, "b") for m, n in values], SCHEMA)


def upsert(old, new):
    return sinks.upsert(old, new, ["model"])


def told(df):
    return sorted((r.model or "", r.n) for r in df.collect())


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), SCHEMA, "model", buckets=8)
    assert told(table.read()) == [] and table.versions() == []
    assert table.update(rows(spark, *[(f"m{k}", k) for k in range(40)], (None, 99)), upsert) == 0
    before = table._folders(0)
    assert table.update(rows(spark, ("m3", 300), ("new", 1)), upsert) == 1
    after = table._folders(1)
    assert 1 <= sum(before.get(b) != after.get(b) for b in after) <= 2
    want = dict([(f"m{k}", k) for k in range(40)] + [("", 99)])
    assert told(table.read(0)) == sorted(want.items())
    assert told(table.read()) == sorted((want | {"m3": 300, "new": 1}).items())


def test_a_failure_leaves_the_old_state(spark, tmp_path, monkeypatch):
    """A writer that dies while it writes, or before its manifest, changes nothing for readers; its folders can be cleaned up."""
    table = Versions(spark, str(tmp_path / "t"), SCHEMA, "model", buckets=2)
    table.update(rows(spark, ("a", 1), ("b", 2)), upsert)

    def breaks(old, new):
        return upsert(old, new).withColumn("n", F.when(F.col("model") == "a", F.raise_error(F.lit("broken"))).otherwise(F.col("n")))

    with pytest.raises(Exception, match="broken"):
        table.update(rows(spark, ("a", 5), ("b", 6)), breaks)
    monkeypatch.setattr(table, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError, match="died"):
        table.update(rows(spark, ("a", 7)), upsert)
    monkeypatch.undo()
    assert told(table.read()) == [("a", 1), ("b", 2)] and table.versions() == [0]
    assert table.clean() >= 1 and told(table.read()) == [("a", 1), ("b", 2)]
    assert table.update(rows(spark, ("a", 8)), upsert) == 1 and told(table.read()) == [("a", 8), ("b", 2)]
    assert table.clean() >= 0 and table.versions() == [1] and told(table.read()) == [("a", 8), ("b", 2)]


def test_two_writers_of_one_version(spark, tmp_path):
    """The second one fails and nothing of it is seen."""
    path = str(tmp_path / "t")
    one, other = Versions(spark, path, SCHEMA, "model"), Versions(spark, path, SCHEMA, "model")
    one.update(rows(spark, ("a", 1)), upsert)

    def meanwhile(old, new):
        other.update(rows(spark, ("a", 2)), upsert)
        return upsert(old, new)

    with pytest.raises(Conflict):
        one.update(rows(spark, ("a", 3), ("c", 3)), meanwhile)
    assert told(one.read()) == [("a", 2)]


def test_documents_of_models(spark, tmp_path):
    """A run's document is merged into the stored one; empty updates are versions too."""
    kind = "model string, base_url string, started_at string, last_updated_at string, tasks map<string,double>"
    table = Versions(spark, str(tmp_path / "t"), T.StructType.fromDDL(kind), "model")
    run = lambda *r: spark.createDataFrame([(m, "u", t) for m, t in r], "model string, base_url string, tasks map<string,double>")
    table.update(run(("a", {"x": 1.0}), ("b", {"x": 2.0})), lambda old, new: sinks.updated_documents(old, new, "t0"))
    table.update(run(("a", {"y": 3.0})), lambda old, new: sinks.updated_documents(old, new, "t1"))
    got = {r.model: (r.started_at, r.last_updated_at, r.tasks) for r in table.read().collect()}
    assert got == {"a": ("t0", "t1", {"x": 1.0, "y": 3.0}), "b": ("t0", None, {"x": 2.0})}
    assert table.update(run(("a", {})).limit(0), lambda old, new: sinks.updated_documents(old, new, "t2")) == 2
    assert len(table.read().collect()) == 2
