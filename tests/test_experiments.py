"""Experiments with recorded replies: each prompt gets its replies one after another."""

import json

from verdigris.operators import abtests
from verdigris.plans import experiments as E
from verdigris.sources.endpoint import Settings

SETTINGS = Settings(wait=0.0)


class Recorded:
    """Replies by a word of the prompt, in the order of calls; the last one stays. An exception is raised."""

    def __init__(self, replies):
        self.replies, self.calls = replies, {}

    def __call__(self, prompt):
        word = next((w for w in self.replies if w in prompt), None)
        if word is None:
            raise AssertionError(f"not recorded: {prompt}")
        n = self.calls[prompt] = self.calls.get(prompt, 0) + 1
        reply = self.replies[word][min(n, len(self.replies[word])) - 1]
        if reply == "down":
            raise ConnectionError("down")
        return {"content": reply, "prompt_tokens": len(prompt), "completion_tokens": len(reply)}


def scenario(idiom, **more):
    return json.dumps({"idiom_prompt": f" 如{idiom}者 ", "literal_prompt": "lit", "question": "why? ", **more}, ensure_ascii=False)


def test_scenarios(spark):
    replies = {
        "甲乙": ["no json", '{"idiom_prompt": "甲乙"}', f"```json\n{scenario('甲乙')}\n```"],  # good in the end
        "丙丁": ["down", f"Here: {scenario('丙丁', extra=1)} done"],
        "戊己": [scenario("other")],  # the idiom is never in it
        "庚辛": ["{broken", '["庚辛"]', '{"idiom_prompt": 3, "literal_prompt": "", "question": ""}'],
    }
    seeds = spark.createDataFrame([("甲乙", "g"), ("丙丁", None), ("戊己", "x"), ("庚辛", "y"), ("壬癸", "known")], "idiom string, gloss string")
    log = spark.createDataFrame([("壬癸",)], "idiom string")
    got = {tuple(r) for r in E.scenarios(seeds, lambda: Recorded(replies), "Answer in JSON.", SETTINGS, log).collect()}
    assert got == {("甲乙", "g", "如甲乙者", "lit", "why?"), ("丙丁", None, "如丙丁者", "lit", "why?")}


def test_judging(spark):
    answers = [(i, m, v, f"{v} answer of {i} by {m} with {{question}}") for i in ("one", "two", "bad") for m in ("m1", "m2") for v in ("idiom", "literal")]
    answers += [("lone", "m1", "idiom", "only"), ("failed", "m1", "idiom", "__ERR__ x"), ("failed", "m1", "literal", "y"), ("known", "m1", "idiom", "a"), ("known", "m1", "literal", "b"), ("nowhere", "m1", "idiom", "a"), ("nowhere", "m1", "literal", "b")]
    table = spark.createDataFrame(answers, "idiom string, model string, version string, answer string")
    found = spark.createDataFrame([(i, f"scene {i}", f"question {i}") for i in ("one", "two", "bad", "lone", "failed", "known")], "idiom string, idiom_prompt string, question string")
    log = spark.createDataFrame([("known", "m1")], "idiom string, model string")
    replies = {
        "scene one": ['{"winner": "C"}', 'Well: {"winner": " A ", "reason": "clear"}'],
        "scene two": ['{"winner": "Tie"}'],
        "scene bad": ["A", '{"winner": 1}', '{"reason": "A"}'],
    }
    got = {(r.idiom, r.model): r for r in E.judged(table, found, lambda: Recorded(replies), "j", "Judge.", SETTINGS, log).collect()}
    assert got.keys() == {(i, m) for i in ("one", "two") for m in ("m1", "m2")}
    for (idiom, _), r in got.items():
        assert (r.judge, r.ordering in (E.IDIOM_FIRST, E.LITERAL_FIRST)) == ("j", True)
        if idiom == "one":
            assert (r.winner_raw, r.reason, r.winner) == ("A", "clear", "idiom" if r.ordering == E.IDIOM_FIRST else "literal")
        else:
            assert (r.winner_raw, r.reason, r.winner) == ("Tie", "", "tie")


def test_what_a_judge_sees(spark):
    """The order of the hash, and answers as they are, whatever braces they have."""
    seen = []
    answers = spark.createDataFrame([("x", f"m{k}", v, f"{v}-{{idiom_prompt}}-%s") for k in range(12) for v in ("idiom", "literal")], "idiom string, model string, version string, answer string")
    found = spark.createDataFrame([("x", "scene", "q")], "idiom string, idiom_prompt string, question string")

    def client(prompt):
        return {"content": json.dumps({"winner": "A", "reason": prompt})}

    for r in E.judged(answers, found, lambda: client, "j", settings=SETTINGS).collect():
        first = "idiom" if r.ordering == E.IDIOM_FIRST else "literal"
        other = {"idiom": "literal", "literal": "idiom"}[first]
        assert r.reason == E.JUDGE_PROMPT % ("scene", "q", f"{first}-{{idiom_prompt}}-%s", f"{other}-{{idiom_prompt}}-%s")
        assert r.winner == first
        seen.append(first)
    assert {"idiom", "literal"} == set(seen) and len(seen) == 12


def test_versions(spark):
    prompts = spark.createDataFrame([("q1", "modern", "long question one"), ("q1", "classical", "one"), ("q2", "modern", "__ERR__ no"), ("q2", "classical", "two"), ("q3", "modern", None)], "question_id string, version string, prompt string")
    questions = spark.createDataFrame([("q1", "s", "B"), ("q2", "s", "C"), ("q3", "t", "A")], "question_id string, source_config string, correct_letter string")
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    log = spark.createDataFrame([("q1", "modern", "m2")], "question_id string, version string, model string")
    replies = {"question one": ["down", " (b) "], "two": ["down"], "one": ["It is C."]}
    rows = E.versions(prompts, questions, models, lambda: Recorded(replies), {"classical": "Say a letter."}, SETTINGS, log).collect()
    got = {(r.question_id, r.version, r.model): r for r in rows}
    assert got.keys() == {("q1", "modern", "m1"), ("q1", "classical", "m1"), ("q1", "classical", "m2"), ("q2", "classical", "m1"), ("q2", "classical", "m2")}
    good = got["q1", "modern", "m1"]
    assert (good.predicted, good.is_correct, good.prompt_chars, good.output_chars, good.prompt_tokens, good.error) == ("B", True, 17, 5, 17, None)
    wrong = got["q1", "classical", "m1"]
    assert (wrong.predicted, wrong.is_correct, wrong.prompt_chars, wrong.prompt_tokens) == ("C", False, 3, len("Say a letter.\n\none"))
    down = got["q2", "classical", "m2"]
    assert (down.predicted, down.raw_response, down.is_correct, down.prompt_chars, down.output_chars, down.prompt_tokens, down.latency_s, down.error) == (None, None, False, 0, 0, 0, 0.0, "ConnectionError: down")
    table = spark.createDataFrame(rows)
    acc = {(r.model, r.version): (r.n, r.n_ok, r.accuracy) for r in abtests.version_accuracy(table, ["modern", "classical"]).collect()}
    assert acc == {("m1", "modern"): (1, 1, 1.0), ("m1", "classical"): (2, 1, 0.0), ("m2", "classical"): (2, 1, 0.0)}
