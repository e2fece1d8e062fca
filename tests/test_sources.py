import json

import pytest
from pyspark.sql import functions as F

from verdigris import schemas
from verdigris.plans import reports
from verdigris.sources import concatenated, endpoint, readers, sinks
from verdigris.streaming import logs


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    rows = [{"id": "a#1", "task": "t", "input": "天", "metadata": {"source": "s", "ref_ratio": 0.5}}, {"id": "a#2"}]
    path = write(tmp_path / "a.jsonl", "\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n")
    got = {r.id: r for r in readers.json_lines(spark, path).collect()}
    assert got["a#1"].metadata == {"source": "s", "ref_ratio": "0.5"} and got["a#2"].input is None
    broken = write(tmp_path / "b.jsonl", '{"id": "x"}\n{"id": \n')
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, broken).collect()
    assert readers.json_lines(spark, broken, mode="DROPMALFORMED").count() == 1


def test_judgement_log(spark, tmp_path):
    lines = [{"model": "m", "task": "t", "id": "1", "judge": 3}, {"model": "m", "task": "t", "id": "1", "judge": 5}, {"model": "m", "task": "t", "id": "2", "judge": None}]
    path = write(tmp_path / "log.jsonl", "\n".join(map(json.dumps, lines)) + "\nnot json\n")
    log = readers.judgements(spark, path)
    assert log.count() == 2
    assert [(r.id, r.judge) for r in logs.compacted(log, ["model", "task", "id"], "seq").collect()] == [("1", 5)]


def test_result_documents(spark, tmp_path):
    item = {"id": "t#1", "input": "i", "reference": "r", "prediction": None, "scores": {"chrf": 0.5, "char_f1": 0.7}}
    doc = {"model": "m1", "tasks": {"translate": {"task": "translate", "n": 1, "summary": {"chrf": 0.5}, "items": [item]}}}
    write(tmp_path / "m1.json", json.dumps(doc, indent=1))
    write(tmp_path / "m2.json", json.dumps({"tasks": doc["tasks"]}))
    write(tmp_path / "bad.json", "{")
    write(tmp_path / "_bootstrap.json", "{}")
    docs = readers.results(spark, str(tmp_path))
    assert {r.model for r in docs.filter("tasks IS NOT NULL").collect()} == {"m1", "m2"} and docs.filter("tasks IS NULL").count() == 1
    assert {(r.model, r.id, r.metric, r.score) for r in readers.item_scores(docs).collect()} == {(m, "t#1", k, v) for m in ("m1", "m2") for k, v in item["scores"].items()}


def test_concatenated_and_array_json(spark, tmp_path):
    path = write(tmp_path / "c.json", '{"char": "山", "content": "a{"}\n,{"char": "水", "content": "b"}, junk {bad} {"char": "x"}{')
    assert [(r.char, r.content) for r in concatenated.concatenated_json(spark, path, schemas.DEFINITION).collect()] == [("山", "a{"), ("水", "b"), ("x", None)]
    array = write(tmp_path / "d.json", '[{"char": "山", "content": "a"}, {"char": "水"}]')
    assert readers.json_array(spark, array, schemas.DEFINITION).count() == 2


def test_seeds(spark, tmp_path):
    path = write(tmp_path / "seed.txt", "# comment\n\n一石二鸟 | two | birds\n画蛇添足\n一石二鸟 | again\n")
    assert {r.idiom: r.gloss for r in readers.seeds(spark, path).collect()} == {"一石二鸟": "two | birds", "画蛇添足": ""}


def test_questions(spark):
    df = spark.createDataFrame([(k, "B" if k != 1 else None) for k in range(5)], "n int, correct_letter string")
    got = readers.questions({"x": (df, 3), "y": (df, 1)}, "n", F.col("correct_letter").isNotNull())
    assert sorted((r.source_config, r.n) for r in got.collect()) == [("x", 0), ("x", 2), ("y", 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", "t", 1), ("m", "u", None)], "model string, task string, v int")
    sinks.json_lines(df, str(tmp_path / "o"))
    sinks.append(df, str(tmp_path / "o"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "o")).count() == 4
    assert json.loads(sinks.document(df.filter("v = 1")).first().value) == {"model": "m", "task": "t", "v": 1}
    new = spark.createDataFrame([("m", "u", 5), ("m", "w", 6)], df.schema)
    assert sorted((r.task, r.v) for r in sinks.upsert(df, new, ["model", "task"]).collect()) == [("t", 1), ("u", 5), ("w", 6)]
    assert sorted((r.task, r.old, r.new) for r in sinks.changes(df, new, ["model", "task"], "v").collect()) == [("t", 1, None), ("u", None, 5), ("w", None, 6)]


def test_endpoint(spark):
    df = spark.createDataFrame([(1, "say\nyes"), (2, "fail"), (3, None)], "id int, prompt string")

    def make_client():
        def client(prompt):
            if prompt == "fail":
                raise TimeoutError("slow")
            lines = prompt.splitlines()
            return {"content": lines[-1] if lines else None, "prompt_tokens": len(prompt)}

        return client

    got = {r.id: r for r in endpoint.predictions(df, make_client, settings=endpoint.Settings(retries=2, wait=0.0)).collect()}
    assert (got[1].prediction, got[1].error, got[1].prompt_tokens) == ("yes", None, 7)
    assert (got[2].prediction, got[2].error, got[2].prompt_tokens) == ("", "TimeoutError: slow", None)
    assert got[3].prediction == ""
    assert endpoint.stub("a\nb")["content"] == "b"


def test_resume_and_stream(spark, tmp_path):
    work = spark.createDataFrame([(k, f"w{k}") for k in range(6)], "k long, v string")
    log = str(tmp_path / "log")
    for n, part in enumerate(([0, 1, 1], [1, 2, 3])):
        work.filter(F.col("k").isin(part)).unionByName(work.filter(F.col("k").isin(part[:1]))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        logs.stream_to_log(spark.readStream.schema(work.schema).parquet(str(tmp_path / "in")), log, str(tmp_path / "cp"), ["k"]).awaitTermination()
        assert n or spark.read.parquet(log).count() == 2
    done = spark.read.parquet(log)
    assert sorted(r.k for r in done.collect()) == [0, 1, 2, 3]
    assert sorted(r.k for r in logs.pending(work, done, ["k"]).collect()) == [4, 5]


def test_reports(spark):
    board = spark.createDataFrame([("m", "translate", 0.5, 0.01, 0.6, 1), ("m", "fill-in", 0.7, None, 0.6, 1)], "model string, task string, mean double, half_width double, avg double, place int")
    text = reports.leaderboard_report(board)
    assert "| m | 0.500 ±0.010 | — | — | — | 0.700 | — | 0.600 |" in text
    judged = spark.createDataFrame([("m", "translate", 0.5, True, -1.0)], "model string, task string, judge_mean double, partial boolean, judge_avg double")
    assert "0.500*" in reports.judged_report(judged)
    assert reports.markdown(judged, {"model": "Model", "judge_mean": "Judge"}).splitlines()[0] == "| Model | Judge |"
