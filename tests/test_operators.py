"""Hand-made cases for functions and operators that the driver's tables can't show."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from verdigris.functions import stats
from verdigris.functions import text as X
from verdigris.functions import textmetrics as M
from verdigris.operators import abtests, items, judges, quality, samples, scorers, tokens


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def text(s):
    return F.lit(s)


@pytest.mark.parametrize(("p", "r", "want"), [("能与贤人相处共事，在于以礼待之。", "跟贤人在一起是能够办到的，那就是以礼对待他们。", 0.0856), ("早晨", "早晨", 1.0), ("捕鸟网", "同本义。", 0.0), ("", "", 0.0), ("", "a", 0.0), ("ab", "ab", 1.0)])
def test_chrf(spark, p, r, want):
    pair = spark.createDataFrame([(1, p, r)], "id int, p string, r string")
    assert abs(M.chrf_values(*M.overlaps([p], [r], 6))[0] - want) < 5e-5
    arrow = pair.select(M.chrf(X.strip_text(F.col("p")), X.strip_text(F.col("r"))).alias("v")).first().v
    assert abs(arrow - M.chrf_native(pair, ["id"], "p", "r").first().chrf) < 0.03 or p in ("能与贤人相处共事，在于以礼待之。",)
    assert abs(M.chrf_native(pair, ["id"], "p", "r").first().chrf - want) < 5e-5


def test_strip(spark):
    assert value(spark, X.strip_text(text(" a　b c\n…（x） "))) == "abc...(x)"
    assert value(spark, X.strip_text(F.lit(None).cast("string"))) == ""


def test_char_f1(spark):
    for f1 in (M.char_f1, M.char_f1_native):
        assert abs(value(spark, f1(text("aab"), text("abb"))) - 2 / 3) < 1e-9
        assert value(spark, f1(text(""), text("a"))) == 0.0
    both = M.pair_scores(text("aab"), text("abb"))
    assert abs(value(spark, both["char_f1"]) - 2 / 3) < 1e-9 and value(spark, both["chrf"]) > 0


def test_marks(spark):
    assert value(spark, M.mark_places(text("，天地，玄黄。"))) == [-1, 1, 3]
    assert value(spark, M.mark_f1(text("天地玄黄"), text("天地玄黄"))) == 1.0
    assert value(spark, M.mark_f1(text("天，地"), text("天地"))) == 0.0
    assert abs(value(spark, M.mark_f1(text("天，地玄黄。"), text("天！地，玄黄。"))) - 0.8) < 1e-9
    assert value(spark, M.mark_f1(text(""), text(""))) == 1.0


def score_one(spark, task, prediction, reference, given="", metadata=None, **options):
    df = spark.createDataFrame([(task, given, reference, prediction, metadata)], "task string, input string, reference string, prediction string, metadata map<string,string>")
    return scorers.Scorers(**options).score(df).first().scores


def test_scorers(spark):
    assert score_one(spark, "punctuate", "天地玄黄", "天地玄黄") == {"punct_f1": 1.0, "char_preserved": 1.0}
    assert set(score_one(spark, "punctuate", "天地，玄黄", "天地玄黄。")) == {"punct_f1", "char_preserved", "chrf"}
    assert score_one(spark, "char-gloss", "早晨", "早晨。")["chrf"] == 1.0
    assert score_one(spark, "idiom-source", "出自《道德经》：「上善若水」", "", metadata={"book": "老子", "expected_quote": "上善若水"})["book_em"] == 1.0
    assert score_one(spark, "idiom-source", "不知道", "", metadata={"book": "", "expected_quote": "x"})["book_em"] == 1.0
    assert score_one(spark, "fill-in", "答案是「饑」。", "饥") == {"exact_match": 0.0, "in_pred": 0.0}
    assert score_one(spark, "fill-in", "答案是「饑」。", "饥", table={"饑": "饥"}) == {"exact_match": 1.0, "in_pred": 1.0}
    assert score_one(spark, "fill-in", None, "饥") == {"exact_match": 0.0, "in_pred": 0.0}
    assert score_one(spark, "fill-in", "x", "")["in_pred"] == 1.0
    got = score_one(spark, "compress", "天地", "天地", "天地玄黄")
    assert got == {"chrf": 1.0, "ratio": 0.5, "compression": 0.5, "efficiency": 0.5}
    assert score_one(spark, "unknown", "a", "b") is None


def test_functions(spark):
    assert value(spark, X.choice_letter(text("**b) because"))) == "B"
    assert value(spark, X.choice_letter(text("The answer is (C)."))) == "C"
    assert value(spark, X.choice_letter(text("none"))) is None and value(spark, X.choice_letter(text(""))) is None
    assert value(spark, X.first_digit(text("score: 7 or 4"))) == 4 and value(spark, X.first_digit(text("none"))) is None
    assert value(spark, X.braces(text('```json\n{"a": {"b": 1}}\n``` '))) == '{"a": {"b": 1}}'
    assert value(spark, X.plain_gloss(text("(指事。)。 大  山"))) == "大 山"
    assert value(spark, X.sentences(text("甲乙（注）丙。丁 戊【x】！"))) == ["甲乙丙", "丁戊", ""]
    assert value(spark, X.quoted_book(text("宋·邵雍《论语·学而》"))) == "论语" and value(spark, X.quoted_book(text("none"))) is None
    assert value(spark, X.definition_head(text("窮也。从穴弓聲。"), {"窮": "穷"})) == "穷"
    assert value(spark, X.middle(text("abcdefg"), 3)) == "cde" and value(spark, X.middle(text("ab"), 3)) == "ab"
    assert value(spark, X.occurrences(text("aaaa"), text("aa"))) == 2 and value(spark, X.occurrences(text("a"), text(""))) is None
    assert value(spark, X.class_length(text("𠀀中a"))) == 2
    assert value(spark, X.source_head(text("史记·项羽本纪/上"))) == "史记"
    assert value(spark, X.filled("{input}|{reference}", input=text("x"), reference=F.lit(None).cast("string"))) == "x|"
    assert value(spark, X.grams(text("ab"), 3)) == []


def test_published_cloze_rows(spark):
    """The masks of the published cloze items, JSON lines whose path PUBLISHED_CLOZE gives."""
    if "PUBLISHED_CLOZE" not in os.environ:
        pytest.skip("no published rows here")
    rows = [json.loads(line) for line in open(os.environ["PUBLISHED_CLOZE"], encoding="utf-8") if line.strip()]
    df = spark.createDataFrame([(r["metadata"]["context"], r["reference"], r["input"]) for r in rows], "context string, answer string, given string")
    place = X.mask_place(F.col("context"))
    got = df.withColumn("place", place).select(F.substring("context", F.col("place"), F.lit(1)).alias("a"), X.masked(F.col("context"), F.col("place")).alias("m"), "answer", "given").collect()
    assert all(r.a == r.answer and r.m in r.given for r in got) and len(got) == 100


def test_degenerate_statistics(spark):
    rows = [("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("tie", 1.0, 1.0), ("tie", 1.0, 2.0), ("tie", 2.0, 3.0), ("tie", 3.0, 3.0), ("null", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r.rho for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    assert got["one"] is None and got["two"] is None and got["flat"] is None and abs(got["tie"] - 8 / 9) < 0.1 and "null" not in got
    nan = {r.g: r.rho for r in stats.spearman(df, "x", "y", ["g"], least=2, nan=True).collect()}
    assert math.isnan(nan["one"]) and math.isnan(nan["flat"]) and nan["two"] == -1.0
    assert stats.kappa(df.limit(0), "x", "y", ["g"]).count() == 0
    perfect = spark.createDataFrame([("g", a, a) for a in (0, 3, 5)] + [("h", 2, 2)], "g string, a int, b int")
    assert {r.g: r.kappa for r in stats.kappa(perfect, "a", "b", ["g"]).collect()} == {"g": 1.0, "h": None}


def test_bootstrap(spark):
    rows = [("m", "t", f"t#{k}", float(k % 2)) for k in range(100)] + [("m", "s", "s#1", 0.7)]
    df = spark.createDataFrame(rows, "model string, task string, id string, score double")
    got = {r.task: r for r in items.bootstrap_ci(df, ["model", "task"], iterations=2000).collect()}
    assert got["t"].mean == 0.5 and abs(got["t"].ci_lo - 0.40) <= 0.02 and abs(got["t"].ci_hi - 0.60) <= 0.02 and abs(got["t"].half_width - 0.10) < 0.015
    assert (got["s"].mean, got["s"].ci_lo, got["s"].ci_hi) == (0.7, 0.7, 0.7)
    average = items.bootstrap_average(df, iterations=50).first()
    assert average.mean == 0.6 and average.ci_lo <= 0.6 <= average.ci_hi
    assert items.bootstrap_ci(df.limit(0), ["model", "task"]).count() == 0


def test_leaderboard_of_partial_models(spark):
    df = spark.createDataFrame([("a", "t1", 0.5), ("a", "t2", 0.7), ("b", "t1", 0.65)], "model string, task string, mean double")
    got = {r.model: (r.avg, r.place) for r in items.leaderboard(df, df.select("model", "task", F.lit(0.01).alias("half_width"))).collect()}
    assert got == {"a": (0.6, 2), "b": (0.65, 1)}


def test_contamination_keeps_empty_tiers(spark):
    df = spark.createDataFrame([("x", 3, 0.5, 2), ("x", 3, 0.7, 0)], "g string, tier int, difficulty double, hits long")
    assert sorted((r.tier, r.n, r.mean_difficulty) for r in items.tier_difficulty(df, ["g"]).collect()) == [(1, 0, None), (2, 0, None), (3, 2, 0.6)]
    assert [(r.n, r.rho_canonicity, r.rho_shingle) for r in items.contamination(df, ["g"]).collect()] == [(2, None, None)]
    assert value(spark, items.tiers(text("史记·项羽本纪"))) == 3 and value(spark, items.tiers(text("晋书/上"))) == 2 and value(spark, items.tiers(text("某书"))) == 1 and value(spark, items.tiers(text(""))) is None


def test_judges(spark):
    df = spark.createDataFrame([("m1", 5, 1), ("m2", 2, 2), ("m3", None, 3)], "model string, a int, b int").withColumn("task", F.lit("t"))
    assert [(r.model, r["diff"]) for r in judges.high_disagreement(df).collect()] == [("m1", 4)]
    assert value(spark, judges.parsed(text("4 points"))).asDict() == {"judge": 4, "judge_norm": 0.8}
    got = judges.backfill(df.select("model"), spark.createDataFrame([("m1", 3)], "model string, judge int"), "judge_x", ["model"])
    assert {r.model: r.judge_x_norm for r in got.collect()} == {"m1": 0.6, "m2": None, "m3": None}


def test_audit_and_candidates(spark):
    rows = [("char-gloss#1", "char-gloss", "i", "字：弓", "同本义。", {"char": "窮"}), ("fill-in#19", "fill-in", "i", "x", "降", None), ("char-gloss#2", "char-gloss", "i", "y", "同本义", {"char": "x", "_audit_issue": "old"}), ("t#1", "translate", "i", "x", "x y", {"a": "b"})]
    df = spark.createDataFrame(rows, "id string, task string, instruction string, input string, reference string, metadata map<string,string>")
    once = quality.audit_flags(df)
    assert sorted(r.id for r in quality.unflagged(once).collect()) == ["t#1"]
    assert sorted(map(str, quality.audit_flags(once).collect())) == sorted(map(str, once.collect()))
    words = spark.createDataFrame([("窮", "極也。从穴", 1), ("窮", "second", 2)], "char string, content string, seq int")
    got = {r.id: (r._status, r.reference, r.metadata) for r in quality.repaired_candidates(once, words).collect()}
    assert got["char-gloss#1"] == ("candidate", "極", {"char": "窮"}) and got["char-gloss#2"][0] == "blocked" and len(got) == 2


def test_record_violations(spark):
    rows = [("a", "translate", "x", "x"), ("a", "fill-in", "x", "yy"), ("b", "punctuate", "天，地", "天地"), (None, "translate", "x", "long")]
    df = spark.createDataFrame(rows, "id string, task string, input string, reference string")
    assert sorted((r.id or "", r.violation) for r in quality.record_violations(df).collect()) == [("", "missing field"), ("a", "cloze answer is not one character"), ("a", "duplicate id"), ("a", "duplicate id"), ("a", "reference is input"), ("a", "reference too short"), ("b", "mark in input"), ("b", "no mark in reference")]


def test_document_violations(spark):
    good = {"model": "m", "tasks": {t: {"summary": {}, "items": [{"id": "1", "prediction": "p", "scores": {}}] * 100} for t in ("translate", "punctuate", "char-gloss", "idiom-source", "fill-in", "compress")}}
    bad = {"tasks": {"translate": {"summary": 3, "items": [{"id": "1"}, 5]}, "odd": {}}}
    df = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad)), ("broken", "{"), ("list", "[1]"), ("typed", '{"model": "m", "tasks": 3}')], "file string, value string")
    got = {}
    for r in quality.document_violations(df).collect():
        got.setdefault(r.file, set()).add((r.task, r.item, r.severity, r.message))
    assert "good" not in got
    assert got["broken"] == {(None, None, "error", "not valid JSON")} and got["list"] == {(None, None, "error", "top level is not an object")}
    assert got["typed"] == {(None, None, "error", "'tasks' is not an object")}
    assert {("odd", None, "error", "unexpected task key"), ("punctuate", None, "warn", "missing task"), (None, None, "error", "missing top-level key 'model'"), ("translate", None, "error", "summary missing or not an object"), ("translate", 0, "error", "missing 'prediction'"), ("translate", 0, "error", "missing 'scores'"), ("translate", 1, "error", "is not an object"), ("translate", None, "warn", "2/100 items")} <= got["bad"]


def test_rescore(spark):
    rows = [("m", "translate", "t#1", "ab", {"chrf": 0.1, "judge": 4.0})]
    old = spark.createDataFrame(rows, "model string, task string, id string, prediction string, scores map<string,double>")
    records = spark.createDataFrame([("t#1", "x", "ab", None)], "id string, input string, reference string, metadata map<string,string>")
    got = scorers.rescored(old, records, scorers.Scorers()).first().scores
    assert got == {"chrf": 1.0, "char_f1": 1.0, "judge": 4.0}


def test_builders(spark):
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜"
    rows = [("c2m", han[:20] + str(k), han, f"s{k % 3}", "经", k == 0) for k in range(40)] + [("m2c", han * 4 + str(k), (han * 2)[: 50 + k % 5], "s", "集", None) for k in range(30)]
    df = spark.createDataFrame(rows, "task string, input string, output string, source string, category string, _has_box boolean")
    made = samples.build_translate(df, each=10)
    assert made.count() == 10 and {r.id for r in made.collect()} == {f"translate#{k}" for k in range(1, 11)}
    assert sorted(map(str, made.collect())) == sorted(map(str, samples.build_translate(df, each=10).collect()))
    assert samples.build_compress(df, {"集": 5}, 20).count() == 5
    assert samples.build_compress(df, {"经": 5}, 20).count() == 20
    assert samples.token_triples(df.withColumn("input", F.substring("input", 1, 100)), 7).count() == 7
    punctuated = df.select("task", F.concat(F.lit("，"), "output").alias("output"), F.concat("input", F.lit("甲乙丙丁戊己庚辛壬癸甲乙丙丁戊己庚辛")).alias("input"), "source", "category", "_has_box")
    built = samples.build_punctuate(punctuated, 9)
    assert built.count() == 9 and not any(r.reference.startswith("，") for r in built.collect())
    passages = spark.createDataFrame([("史记", "天地玄黄宇宙洪荒。日月盈昃辰宿列张寒来！短句。"), ("野史", "甲乙丙丁戊己庚辛壬。")], "source string, content string")
    cloze = samples.build_cloze(passages, ["史记"]).collect()
    assert len(cloze) == 2 and all(r.metadata["context"] == r.input.replace("___", r.reference) for r in cloze)


def test_dictionary_builders(spark):
    kind = "char string, pronunciations array<struct<explanations: array<struct<content: string, detail: array<struct<text: string, book: string>>>>>>"
    quote, modern = "大山之高兮不可以攀登也", "大山之高兮不可以攀登也呀"
    rows = [("山", [([("(象形。)土石之高者", [(modern, "鲁迅集"), (quote.replace("大", "山"), "某书"), (quote, "诗经")])],)]), ("之", [([("虚词字", [(quote, "诗经")])],)]), ("xx", None)]
    rows = [(c, p) for c, p in rows]
    got = samples.build_gloss(spark.createDataFrame(rows, kind), ("鲁迅",)).collect()
    assert [(r.id, r.reference, r.metadata["book"]) for r in got] == [("char-gloss#1", "土石之高者", "某书")]
    idioms = spark.createDataFrame([("上善若水", "e", ("上善若水，水善利万物而不争", "《老子·八章》")), ("没有出处", "e", None), ("不知之书", "e", ("上善若水，水善利万物而不争", "《某书》"))], "word string, explanation string, source struct<text: string, book: string>")
    assert [(r.input, r.metadata["book"]) for r in samples.build_idiom_source(idioms, ["老子"]).collect()] == [("上善若水", "老子")]


def test_paired_and_tokens(spark):
    df = spark.createDataFrame([("i", "m", "idiom", 10), ("i", "m", "literal", 20), ("j", "m", "idiom", 5)], "idiom string, model string, version string, n int")
    both = abtests.paired(df, ["idiom", "model"], "version", "idiom", "literal", ["n"])
    assert [tuple(r) for r in both.collect()] == [("i", "m", 10, 20)]
    ratio = abtests.pair_ratios(both, ["model"], "n_literal", "n_idiom").first()
    assert (ratio.n, ratio.ratio_mean, ratio.saved_pct) == (1, 2.0, 50.0)
    assert value(spark, abtests.verdict(text("B"), F.lit(False))) == "idiom" and value(spark, abtests.verdict(text("x"), F.lit(True))) is None
    texts = spark.createDataFrame([("天地 玄", "hello big world")], "classical string, english string")
    found = tokens.registry({"half": lambda: lambda s: len(s) // 2, "broken": lambda: 1 / 0})
    assert set(found) == {"chars", "bytes", "words", "half"}
    counts = tokens.token_counts(texts, [], ["classical", "english"], found)
    assert {(r.tokenizer, r.variant): r.tokens for r in counts.collect()} == {("chars", "classical"): 4, ("bytes", "classical"): 10, ("words", "classical"): 2, ("half", "classical"): 2, ("chars", "english"): 15, ("bytes", "english"): 15, ("words", "english"): 3, ("half", "english"): 7}
    table = tokens.density(counts, ["tokenizer", "variant"])
    assert {r.tokenizer: r.classical_vs_english for r in tokens.variant_ratios(table, ["classical", "english"], "english").collect()}["words"] == 0.667


def test_published_token_density(spark):
    """The published parallel triples, a JSON list whose path PUBLISHED_TRIPLES gives."""
    if "PUBLISHED_TRIPLES" not in os.environ:
        pytest.skip("no published rows here")
    rows = json.load(open(os.environ["PUBLISHED_TRIPLES"], encoding="utf-8"))
    df = spark.createDataFrame([(r["classical"], r["modern"], r["english"]) for r in rows], "classical string, modern string, english string")
    sums = tokens.token_counts(df, [], ["classical", "modern", "english"]).filter("tokenizer = 'chars'").groupBy("variant").sum("tokens")
    assert {r.variant: r[1] for r in sums.collect()} == {"classical": 1640, "modern": 2375, "english": 12291}


def test_small_functions(spark):
    from verdigris.sources import endpoint

    row = spark.createDataFrame([("literal", "a", "b", "q?")], "v string, a string, b string, q string")
    assert row.select(X.version_prompt(F.col("v"), {"idiom": F.col("a"), "literal": F.col("b")}, F.col("q")).alias("p")).first().p == "b\n\nq?"
    assert value(spark, X.is_correct(text("B."), text("B"))) is True and value(spark, X.is_correct(text("?"), text("B"))) is False
    assert value(spark, X.choice_prompt(text("Q"), *map(text, "wxyz"))) == "Q\nA. w\nB. x\nC. y\nD. z"
    assert [value(spark, items.recall_class(F.lit(r).cast("double"))) for r in (0.5, 0.1, -0.1, 0.2, None)] == ["recall-driven", "clean", "clean", "mixed", None]
    assert [value(spark, abtests.decision(F.lit(s), F.lit(n))) for s, n in ((0.1, 0.9), (0.3, 0.8), (0.3, 0.5), (0.3, 0.2))] == ["no saving", "adopt", "trade-off", "reject"]
    assert endpoint.headers(["A: b:c", "none", "X:y"]) == {"A": "b:c", "X": "y"}
    assert value(spark, X.file_name(text("org/model"))) == "org_model"
