"""Operators of whole jobs, hand-made: memos, lookups, judges that are asked again, ranks, containment and reports."""

import random

import pytest
from pyspark.sql import functions as F

from verdigris.functions import stats
from verdigris.functions import text as X
from verdigris.operators import abtests, containment, items, judges, quality, samples, tokens
from verdigris.plans import reports
from verdigris.sources import endpoint, sinks
from verdigris.tables import small


def test_ranks_as_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([None, 1.5, 2.0, *map(float, range(200))])) for _ in range(3000)]
    rows += [("c", 7.0)] * 500 + [("d", float("nan")), ("d", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").filter("v IS NOT NULL")
    got = {(r.g, repr(r.v)): r.rank for r in stats.average_ranks(df, "v", ["g"], "rank").collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    want = {}
    for g, values in groups.items():
        order = sorted(values, key=lambda v: (v != v, v))
        for v in set(map(repr, values)):
            places = [k for k, o in enumerate(order, 1) if repr(o) == v]
            want[g, v] = sum(places) / len(places)
    assert got == want


def test_spearman_of_null_groups(spark):
    df = spark.createDataFrame([(None, i, i * i) for i in range(9)] + [("x", i, -i) for i in range(9)], "g string, a int, b int")
    assert {r.g: (r.n, round(r.rho, 9)) for r in stats.spearman(df, "a", "b", ["g"]).collect()} == {None: (9, 1.0), "x": (9, -1.0)}


def test_let_computes_once(spark):
    out = spark.createDataFrame([(" a b ", None)], "t string, u string").select(X.let(lambda a, b: F.concat(a, a, F.coalesce(b, F.lit("-"))), a=X.squeeze(F.col("t")), b=F.col("u")).alias("v"))
    assert out.first().v == "abab-"
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_containment(spark):
    corpus = spark.createDataFrame([(1, "aaaa banana"), (2, None), (3, ""), (4, "ana"), (5, "xyz")], "k int, t string")
    parts = spark.createDataFrame([("aa",), ("ana",), ("ana",), ("",), (None,), ("nope",), ("漢",)], "p string")
    want = {(1, "aa", 2), (1, "ana", 1), (4, "ana", 1)}
    assert {tuple(r) for r in containment.occurrences(corpus, parts, "p", "t", ["k"]).collect()} == want
    assert containment.occurrences(corpus, parts.limit(0), "p", "t", ["k"]).columns == ["k", "part", "hits"]


def test_small_is_checked(spark):
    df = spark.range(50)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(df, 50)) and not hinted(small(df, 49))


def test_memo(spark, tmp_path):
    asked = []

    def make(todo):
        asked.append(sorted(r.k for r in todo.collect()))
        return todo.withColumn("v", F.col("k") * 10)

    work = spark.createDataFrame([(1,), (2,)], "k int")
    path = str(tmp_path / "memo")
    for extra in ([], [], [3]):
        rows = work.union(spark.createDataFrame([(k,) for k in extra], "k int")) if extra else work
        assert sorted((r.k, r.v) for r in sinks.remembered(rows, path, ["k"], make).collect()) == [(k, k * 10) for k in [1, 2, *extra]]
    assert asked == [[1, 2], [3]]


def test_lookup_of_unknown_keys(spark):
    rows, found = spark.createDataFrame([("a", 1), ("z", 2)], "idiom string, n int"), spark.createDataFrame([("a", "g")], "idiom string, gloss string")
    with pytest.raises(KeyError, match="z"):
        abtests.with_lookup(rows, found, "idiom")
    assert [tuple(r) for r in abtests.with_lookup(rows, found, "idiom", strict=False).collect()] == [("a", 1, "g")]


class Moody:
    """Answers without a digit at first."""

    def __init__(self):
        self.calls = {}

    def __call__(self, prompt):
        n = self.calls[prompt] = self.calls.get(prompt, 0) + 1
        if "broken" in prompt:
            raise ValueError("down")
        return {"content": "no idea" if n < 3 or "never" in prompt else "score: 4"}


def test_judge_is_asked_again(spark):
    rows = spark.createDataFrame([(1, "i", "r", "late"), (2, "i", "r", "never"), (3, "i", None, "broken")], "k int, input string, reference string, prediction string")
    got = {r.k: (r.prediction, r.judge, r.judge_norm, r.judge_raw, r.judge_error) for r in judges.scored(rows, Moody, "{input}|{reference}|{prediction}", endpoint.Settings(wait=0.0)).collect()}
    assert got == {1: ("late", 4, 0.8, "score: 4", None), 2: ("never", None, None, "no idea", "reply refused"), 3: ("broken", None, None, "", "ValueError: down")}


def test_english_side(spark):
    triples = spark.createDataFrame([("c", "hello", "s", "k", None), ("c", "done", "s", "k", "there")], "classical string, modern string, source string, category string, english string")
    want = [("done", "there"), ("hello", "hello")]
    assert sorted((r.modern, r.english) for r in samples.with_english(triples, lambda: endpoint.stub).collect()) == want
    assert sorted((r.modern, r.english) for r in samples.with_english(triples.drop("english"), lambda: endpoint.stub).collect()) == [("done", "done"), ("hello", "hello")]


def test_null_model_is_present(spark):
    docs = [("a", '{"model": null, "tasks": {}}'), ("b", '{"tasks": {}}'), ("c", '{"model": "m"}')]
    got = {(r.file, r.message) for r in quality.document_violations(spark.createDataFrame(docs, "file string, value string")).collect() if r.severity == "error"}
    assert got == {("b", "missing top-level key 'model'"), ("c", "missing top-level key 'tasks'")}


def test_ties_by_file(spark):
    means = spark.createDataFrame([("b", "t", 0.5, "1.json"), ("a", "t", 0.5, "2.json")], "model string, task string, mean double, file string")
    place = lambda **k: {r.model: r.place for r in items.leaderboard(means, **k).collect()}
    assert place() == {"a": 1, "b": 2} and place(ties="file") == {"b": 1, "a": 2}


def test_shingle_takes_marks_off(spark):
    assert spark.range(1).select(X.shingle(F.lit("「天地，玄 黄。宇宙洪荒…」"), 4).alias("v")).first().v == "玄黄宇宙"


def test_reports(spark):
    profile = spark.createDataFrame([("t", 3, 0.5, None, 1, 0, 1, 2, 0)], "task string, n_items long, difficulty_mean double, discrimination_mean double, dead long, ceiling long, floor long, negative_disc long, low_disc long")
    worst = spark.createDataFrame([("t", "t#1", -0.4)], "task string, id string, discrimination double")
    alike = spark.createDataFrame([("t", "u", 5, 0.9, True), ("t", "t", 5, 1.0, False)], "task_a string, task_b string, n long, rho double, redundant boolean")
    text = reports.item_report(profile, worst, alike)
    assert "| t | 3 | 0.500 | — | 1 | 0 | 1 | 2 | 0 |" in text and "| t | t#1 | -0.400 |" in text and "| t | u | 0.900 |" in text and "| t | t |" not in text
    columns = "task string, n long, rho_canonicity double, rho_shingle double, mean_1 double, n_1 long, mean_2 double, n_2 long, mean_3 double, n_3 long, gap double, class string"
    found = spark.createDataFrame([(None, 4, 0.4, None, 0.1, 2, None, 0, 0.5, 2, 0.4, "recall-driven"), ("t", 4, 0.1, 0.2, 0.1, 2, None, 0, 0.5, 2, 0.4, "clean")], columns)
    assert reports.contamination_report(found).splitlines()[-1] == "| all | 4 | 0.400 | — | 0.500 | — | 0.100 | 0.400 | recall-driven |"
    density = spark.createDataFrame([("chars", 2, 9.0, 1.0), ("bytes", 2, 18.0, 0.5)], "tokenizer string, n long, tokens_mean double, chars_per_token double")
    assert "| 1 | bytes | 0.500 |" in reports.tokenizer_report(density, tokens.ranked(density, "chars_per_token"))
    acc = spark.createDataFrame([("m", "v", 3, 3, 0.5, 10.0, 2.0)], "model string, version string, n long, n_ok long, accuracy double, prompt_chars double, output_chars double")
    deltas = spark.createDataFrame([("v", 1, -1.25, 30.0)], "version string, n_models long, delta_pp double, chars_saved_pct double")
    assert "| v | 1 | -1.25 | 30.0 |" in reports.compression_report(acc, deltas)
    pairs = spark.createDataFrame([("m", 1, 30, 10), ("m", 2, 20, 10)], "model string, q int, a int, b int")
    verdicts = spark.createDataFrame([("m", "idiom"), ("m", "tie"), ("m", None)], "model string, winner string")
    text = reports.ab_report(abtests.report(pairs, verdicts, ["model"], "a", "b"), abtests.top_savings(pairs, ["model"], "q", "a", "b"), "model")
    assert "| m | 2 | 2.500 | 2.500 | 60.000 | 1 | 1 | 0 | 1.000 | adopt |" in text and text.endswith("| m | 1 | 3.000 |\n| m | 2 | 2.000 |")
    assert reports.console(density.orderBy("tokenizer")).splitlines()[1].split() == ["bytes", "2", "18.0", "0.5"]


def test_documents_of_a_run(spark):
    from verdigris.operators.scorers import Scorers
    from verdigris.plans import evaluation

    rows = [("b", "translate", "i", "hello", "hello", None), ("a", "translate", "i", "bye", "bad", None), ("c", "unknown", "i", "x", "y", None)]
    records = spark.createDataFrame(rows, "id string, task string, instruction string, input string, reference string, metadata map<string,string>").repartition(2)
    done = evaluation.answered(records, lambda: endpoint.stub, Scorers(compose=False))
    doc = evaluation.task_results(done, F.lit("m"), F.lit("u")).first()
    task = doc.tasks["translate"]
    assert (task.n, task.errors, [i.id for i in task["items"]], task.summary["chrf"] > 0.5) == (2, 0, ["a", "b"], True) and task.elapsed_sec >= 0
    assert doc.tasks["unknown"].summary is None and doc.tasks["unknown"]["items"][0].scores is None
    updated = sinks.updated_documents(spark.createDataFrame([], "model string, base_url string, started_at string, last_updated_at string, tasks map<string,struct<n:int>>"), evaluation.task_results(done, F.lit("m"), F.lit("u")).withColumn("tasks", F.transform_values("tasks", lambda k, v: F.struct(v["n"].alias("n")))), "then")
    assert [(r.model, r.started_at, r.last_updated_at, r.tasks["translate"].n) for r in updated.collect()] == [("m", "then", None, 2)]
    assert len(spark.range(1).select(evaluation.now().alias("v")).first().v) == 19
