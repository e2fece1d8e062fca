"""Whole experiments with a chat model: scenarios, blind A/B judging and prompt versions, each resumed from its log.

Every job asks for what its log lacks, asks again for replies that don't hold what they should, and gives rows for the log.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators import abtests, samples
from verdigris.sources.endpoint import Client, Settings, predictions
from verdigris.streaming.logs import pending

# What models are asked, the keys and winners that replies must have, the names of the orders, and the mark of a failed prompt.
SCENARIO_PROMPT = "典故：%s\n（参考含义：%s）\n\n请输出 JSON。"
JUDGE_PROMPT = "场景：%s\n\n问题：%s\n\n=== 回答 A ===\n%s\n\n=== 回答 B ===\n%s\n\n请评判。"
SCENARIO_KEYS = ("idiom_prompt", "literal_prompt", "question")
WINNERS = ("A", "B", "Tie")
IDIOM_FIRST, LITERAL_FIRST = "iA_lB", "lA_iB"
FAILED = "__ERR__"


def reply_object(reply: str) -> dict | None:
    """The JSON object of a reply, from its first brace to its last one, fences and words around it left out; None without one."""
    start, end = reply.find("{"), reply.rfind("}")
    try:
        found = json.loads(reply[start : end + 1]) if 0 <= start < end else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def is_scenario(reply: str, idiom: str) -> bool:
    """Whether a reply has all three texts and the idiom is in the one that must have it."""
    found = reply_object(reply)
    return found is not None and all(isinstance(found.get(k), str) for k in SCENARIO_KEYS) and idiom in found["idiom_prompt"]


def is_verdict(reply: str) -> bool:
    found = reply_object(reply)
    return found is not None and isinstance(found.get("winner"), str) and found["winner"].strip() in WINNERS


def _asked(system: str, user: Column) -> Column:
    return X.prompt(F.lit(system), user) if system else user


def _parsed(reply: Column, *keys: str) -> list[Column]:
    found = F.from_json(X.braces(reply), ", ".join(f"{k} string" for k in keys))
    return [F.trim(found[k], F.lit(" \t\n\x0b\x0c\r")).alias(k) for k in keys]


def scenarios(seeds: DataFrame, make_client: Callable[[], Client], system: str = "", settings: Settings = Settings(), log: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(idiom, gloss, idiom_prompt, literal_prompt, question) for seeds (idiom, gloss) that the log lacks. A reply without one of the three texts, or whose
    first one lacks the idiom, is asked for again; an idiom that gets no good one has no row and is asked for in the next run."""
    todo = seeds if log is None else pending(seeds, log, ["idiom"])
    prompt = _asked(system, F.format_string(SCENARIO_PROMPT, F.col("idiom"), F.coalesce("gloss", F.lit(""))))
    asked = predictions(todo.select("idiom", "gloss", prompt.alias("prompt")), make_client, "prompt", settings, accept=is_scenario, context="idiom")
    return asked.filter("error IS NULL").select("idiom", "gloss", *_parsed(F.col("prediction"), *SCENARIO_KEYS))


def idiom_first(idiom: Column, model: Column) -> Column:
    """Whether the idiom's answer is A, by a hash of the pair, so that reruns show the same order."""
    return F.crc32(F.concat_ws("|", idiom, model).cast("binary")) % 2 == 0


def judged(answers: DataFrame, found: DataFrame, make_client: Callable[[], Client], judge: str, system: str = "", settings: Settings = Settings(), log: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(idiom, model, judge, winner, winner_raw, ordering, reason): blind verdicts on pairs of answers.

    ``answers``: (idiom, model, version, answer) with versions idiom and literal; a pair counts if both have one, the first of repeated rows.
    ``found``: the scenarios. A judge sees the question and both answers as A and B, in an order that a hash decides. A reply that is no
    JSON or names no winner is asked for again; a pair without a good one has no row, and the next run asks for it.
    """
    good = samples.answered(answers, "answer", failed=FAILED)
    pairs = abtests.paired(good, ["idiom", "model"], "version", "idiom", "literal", ["answer"])
    todo = pairs if log is None else pending(pairs, log, ["idiom", "model"])
    first = idiom_first(F.col("idiom"), F.col("model"))
    a, b = (F.when(first == is_a, F.col("answer_idiom")).otherwise(F.col("answer_literal")) for is_a in (True, False))
    with_scenario = todo.join(found.select("idiom", "idiom_prompt", "question").dropDuplicates(["idiom"]), "idiom")
    prompt = _asked(system, F.format_string(JUDGE_PROMPT, "idiom_prompt", "question", a, b))
    asked = predictions(with_scenario.select("idiom", "model", prompt.alias("prompt")), make_client, "prompt", settings, accept=is_verdict)
    winner, reason = _parsed(F.col("prediction"), "winner", "reason")
    told = asked.filter("error IS NULL").select("idiom", "model", winner.alias("winner_raw"), F.coalesce(reason, F.lit("")).alias("reason"))
    return told.select("idiom", "model", F.lit(judge).alias("judge"), abtests.verdict(F.col("winner_raw"), first).alias("winner"), "winner_raw", F.when(first, IDIOM_FIRST).otherwise(LITERAL_FIRST).alias("ordering"), "reason")


def versions(prompts: DataFrame, questions: DataFrame, models: DataFrame, make_client: Callable[[], Client], system: dict[str, str] | None = None, settings: Settings = Settings(), log: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """A row for each model, question and version that the log lacks: (question_id, source_config, version, model, predicted, raw_response, correct_letter,
    is_correct, prompt_chars, output_chars, prompt_tokens, completion_tokens, latency_s, error).

    ``prompts``: (question_id, version, prompt); those that failed to be made are left out. ``system``: a text before each version's prompts. A call that
    fails for good has an error, no letter, is wrong, and counts no characters and tokens.
    """
    made = prompts.filter(~F.coalesce(F.col("prompt"), F.lit(FAILED)).startswith(FAILED))
    work = abtests.grid(made, models.select("model"))
    work = work if log is None else pending(work, log, ["question_id", "version", "model"])
    work = work.join(questions.select("question_id", "source_config", "correct_letter"), "question_id")
    before = F.create_map(*[F.lit(x) for pair in (system or {"": ""}).items() for x in pair])
    full = work.withColumn("_asked", F.concat_ws("\n\n", F.nullif(F.try_element_at(before, F.col("version")), F.lit("")), "prompt"))
    asked = predictions(full, make_client, "_asked", settings)
    ok = F.col("error").isNull()
    letter = F.when(ok, X.choice_letter(F.col("prediction")))
    number = lambda c, kind="long": F.when(ok, c).otherwise(0).cast(kind)
    return asked.select(
        "question_id",
        "source_config",
        "version",
        "model",
        letter.alias("predicted"),
        F.when(ok, F.col("prediction")).alias("raw_response"),
        "correct_letter",
        F.coalesce(letter == F.col("correct_letter"), F.lit(False)).alias("is_correct"),
        number(F.char_length("prompt")).alias("prompt_chars"),
        number(F.char_length("prediction")).alias("output_chars"),
        number(F.col("prompt_tokens")).alias("prompt_tokens"),
        number(F.col("completion_tokens")).alias("completion_tokens"),
        number(F.col("latency_s"), "double").alias("latency_s"),
        "error",
    )
