"""Samples without whole sorts, statistics that add up, and logs whose batches cost what they bring."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import items, samples
from verdigris.streaming import logs


@pytest.fixture
def drawn_rows(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["big"] * 20 + ["small", None, ""]), f"n{k}") for k in range(3000)] + [(3000, "one", "x")]
    return spark.createDataFrame(rows, "id int, g string, _n string")


@pytest.mark.parametrize("n", [3, 40])
def test_bottom_k_by_threshold(spark, monkeypatch, drawn_rows, n):
    """Both ways give the first rows of each stratum, null and empty ones apart, and keep a column _n."""
    whole = {(r.id, r.g, r._2) for r in samples.stratified(drawn_rows, "g", "id", n).withColumnRenamed("_n", "_2").collect()}
    monkeypatch.setattr(samples, "FEW", 0)
    few = {(r.id, r.g, r._2) for r in samples.stratified(drawn_rows, "g", "id", n).withColumnRenamed("_n", "_2").collect()}
    assert whole == few and sum(g == "big" for _, g, _ in few) == n and ("one" in {g for _, g, _ in few})
    quota = lambda: sorted(r.id for r in samples.quotas(drawn_rows, "g", "id", {"big": n, "small": 2, "no": 9}, n + 12).collect())
    threshold = quota()
    robin = [r.id for r in samples.round_robin(drawn_rows, "g", "id", n).collect()]
    monkeypatch.setattr(samples, "FEW", 10**6)
    assert quota() == threshold and len(threshold) == n + 12
    assert [r.id for r in samples.round_robin(drawn_rows, "g", "id", n).collect()] == robin and len(robin) == n


def test_lifted_where_chance_is_short(spark, monkeypatch):
    """Rows that repeat a key have one hash: most lie beyond any threshold, and the stratum goes without one."""
    monkeypatch.setattr(samples, "FEW", 0)
    rows = spark.range(5000).select(F.lit("g").alias("g"), F.lit("same key").alias("id"), F.col("id").alias("k"))
    assert samples.stratified(rows, "g", "id", 30).count() == 30


def test_quota_keeps_few_before_the_shuffle(spark, drawn_rows):
    plan = samples.stratified(drawn_rows, "g", "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def scores(seed, models):
    rng = random.Random(seed)
    return [(m, t, f"{t}{k}", None if rng.random() < 0.05 else rng.choice([0.0, 1.0, rng.random()])) for m in models for t in ("a", "b") for k in range(12)]


def test_moments_add_up(spark):
    """A state that models are added to and taken from has the statistics of a full read."""
    schema = "model string, task string, id string, score double"
    rows = scores(1, "mnopq") + [(m, "alone", "x", 0.5 + 0.1 * k) for k, m in enumerate("mnopq")] + [(m, "same", f"s{k}", 0.3) for m in "mnopq" for k in range(3)]
    old, new = [r for r in rows if r[0] in "mno"], [r for r in rows if r[0] in "pq"]
    of = lambda part: spark.createDataFrame(part, schema)
    want = sorted(map(tuple, items.item_stats(of(rows)).collect()))
    state = items.merged_moments(items.item_moments(of(old)), items.item_moments(of(new)))
    got = sorted(map(tuple, items.moment_stats(state).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[3:5] == pytest.approx(w[3:5], abs=1e-4) and (g[5] == w[5] or g[5] == pytest.approx(w[5], abs=1e-4)), (g, w)
    # one model's results are replaced: its old part goes, the new one comes
    other = scores(2, "p")
    again = items.merged_moments(items.merged_moments(state, items.item_moments(of([r for r in rows if r[0] == "p"])), -1), items.item_moments(of(other)))
    want = {tuple(r)[:4] for r in items.item_stats(of([r for r in rows if r[0] != "p"] + other)).collect()}
    assert {tuple(r)[:4] for r in items.moment_stats(again).collect()} == want
    assert items.moment_stats(items.merged_moments(state, state, -1)).count() == 0


def test_log_batches_do_not_read_the_log(spark, tmp_path):
    """Keys are known by the stream's state: earlier batches may be gone, even unreadable, and nothing is written twice."""
    source, log, checkpoint = (str(tmp_path / c) for c in ("in", "log", "cp"))
    rows = lambda *ks: spark.createDataFrame([(k, f"v{k}") for k in ks], "k int, v string")
    rows(1, 2).write.parquet(f"{log}/batch=-1")

    def run(*ks):
        rows(*ks).coalesce(1).write.mode("append").parquet(source)
        logs.stream_to_log(spark.readStream.schema("k int, v string").parquet(source), log, checkpoint, ["k"]).awaitTermination()

    run(2, 3, 3, 4)
    run(4, 5)
    assert sorted(r.k for r in spark.read.parquet(log).collect()) == [1, 2, 3, 4, 5]
    for file in pathlib.Path(log).glob("batch=*/*.parquet"):
        file.write_bytes(b"broken")
    run(1, 3, 5, 6)
    last = max(pathlib.Path(log).glob("batch=*"), key=lambda p: int(p.name.split("=")[1]))
    assert [r.k for r in spark.read.parquet(str(last)).collect()] == [6]


def test_repeated_batch_writes_over_itself(spark, tmp_path, monkeypatch):
    """A batch that dies after its write is run again and leaves each key once."""
    source, log, checkpoint = (str(tmp_path / c) for c in ("in", "log", "cp"))
    spark.createDataFrame([(k,) for k in range(20)], "k int").write.parquet(source)
    real, calls = logs.pending, []

    def dies(work, known, keys):
        out = real(work, known, keys)
        calls.append(1)
        if len(calls) == 1:
            out.write.mode("overwrite").parquet(f"{log}/batch=0")
            raise RuntimeError("the driver is gone")
        return out

    monkeypatch.setattr(logs, "pending", dies)
    stream = lambda: logs.stream_to_log(spark.readStream.schema("k int").parquet(source), log, checkpoint, ["k"])
    with pytest.raises(Exception, match="the driver is gone"):
        stream().awaitTermination()
    stream().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(log).collect()) == list(range(20))
