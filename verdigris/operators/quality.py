"""Checks of records and result documents, audit flags and repaired candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions import text as X
from verdigris.operators.samples import first_by
from verdigris.schemas import ITEMS_PER_TASK, TASKS

ISSUE = "_audit_issue"
# A gloss that only points at another one, messages of the checks, what is said of repaired glosses, and flags by id.
CIRCULAR = "同本义"
CIRCULAR_ISSUE = "circular gold: reference is the dictionary stub '同本义。' (a 本义 defined elsewhere), not a usable gloss — every model scores ≈0 regardless of answer"
NOT_JSON, NO_TOP, NO_KEY, NO_TASKS = "not valid JSON", "top level is not an object", "missing top-level key '{}'", "'tasks' is not an object"
NO_TASK, ODD_TASK, NO_SUMMARY, NO_ITEMS, NO_OBJECT = "missing task", "unexpected task key", "summary missing or not an object", "items missing or not a list", "is not an object"
TOO_MANY, TOO_FEW = "%d items, max allowed %d", "%d/%d items"
CANDIDATE_FROM, NO_CHARACTER, NO_CANDIDATE = "说文解字「%s」: %s", "no target char", "char '%s' not in 说文 / no clean head"
REVIEW, BY_HAND = "human/judge review + scoped rerun before adoption", "manual gloss from a modern Classical dictionary"
EXPLICIT = {
    "idiom-source#52": "disputed source: idiom canonically from 尚书·周官 '论道经邦'; gold 隋书 is a later usage — multiple defensible answers",
    "fill-in#19": "ambiguous cloze: gold 降 (孟子 quoting 尚书); 佑 is an attested variant in transmitted 尚书 ('天佑下民')",
}


def audit_flags(records: DataFrame, explicit: dict[str, str] = EXPLICIT) -> DataFrame:
    """Records with the audit issue put into their metadata; never clears one, and a second run changes nothing."""
    bare = F.regexp_replace(F.trim("reference"), r"[，。、；：！？\s]", "")
    want = F.when((F.col("task") == "char-gloss") & (bare == CIRCULAR), CIRCULAR_ISSUE)
    for key, issue in explicit.items():
        want = F.when(F.col("id") == key, issue).otherwise(want)
    metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(metadata, lambda k, _: k != ISSUE)
    return records.withColumn("metadata", F.when(want.isNotNull(), F.map_concat(kept, F.create_map(F.lit(ISSUE), want))).otherwise(metadata))


def unflagged(records: DataFrame) -> DataFrame:
    return records.filter(F.col("metadata")[ISSUE].isNull())


def record_violations(records: DataFrame) -> DataFrame:
    """(id, violation), a row for each record: duplicate ids, missing fields, a reference that is the input, too short references, cloze answers of another length than one."""
    checks: dict[str, Column] = {
        "missing field": F.col("id").isNull() | F.col("task").isNull() | F.col("input").isNull() | F.col("reference").isNull() | (F.trim("input") == "") | (F.trim("reference") == ""),
        "reference is input": F.trim("input") == F.trim("reference"),
        "reference too short": (F.col("task") != "fill-in") & (F.char_length(F.trim("reference")) < 2),
        "cloze answer is not one character": (F.col("task") == "fill-in") & (F.char_length(F.trim("reference")) != 1),
        "no mark in reference": (F.col("task") == "punctuate") & (F.col("reference") == X.without(F.col("reference"), X.PUNCTUATION)),
        "mark in input": (F.col("task") == "punctuate") & (F.col("input") != X.without(F.col("input"), X.PUNCTUATION)),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    plain = records.select("id", F.explode(found).alias("violation"))
    # ids alone are counted, texts stay where they are; an id that repeats becomes as many rows
    repeated = records.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = repeated.select("id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("id", F.lit("duplicate id").alias("violation"))
    return plain.unionByName(again)


def _object(of: Column, path: str = "$") -> Column:
    """The members of a JSON object as a map; null for anything else, JSON's null among it."""
    return F.try_variant_get(of, path, "map<string,variant>")


def document_violations(raw: DataFrame, tasks: tuple[str, ...] = TASKS, most: int = ITEMS_PER_TASK) -> DataFrame:
    """(file, task, item, severity, message) for result documents, from (file, value: the whole text).

    One rule at a time, from the outside in: what is no JSON or no object has one message; without ``tasks`` every task is missing, a
    warning each; ``tasks``, a task or an item that is no object has one message and nothing in it is looked at, nor are items
    beyond the first ``most``. Presence is checked in the JSON text itself, so wrong types can't be lost in a schema. An empty message table is a good document.
    """
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda message, task=None, item=None, severity="error": F.struct((none("string") if task is None else task).alias("task"), (none("int") if item is None else item).alias("item"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
    told = lambda rows: F.filter(rows, lambda x: x.isNotNull())
    known = F.array(*map(F.lit, sorted(tasks)))

    parsed = raw.select("file", F.try_parse_json("value").alias("v"))
    top = parsed.select("file", F.col("v").isNotNull().alias("json"), _object(F.col("v")).alias("top"))
    keys = F.map_keys("top")
    of = F.try_element_at("top", F.lit("tasks"))
    # without the key there are no tasks; with another kind of value they are null
    whole = top.select("file", "json", "top", F.when(F.array_contains(keys, "tasks"), _object(of)).when(F.col("top").isNotNull(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))).alias("tasks"))
    have = F.map_keys("tasks")
    heads = F.concat(
        F.array(
            F.when(~F.array_contains(keys, "model"), row(NO_KEY.format("model"))),
            F.when(~F.array_contains(keys, "tasks"), row(NO_KEY.format("tasks"))),
            F.when(F.col("tasks").isNull(), row(NO_TASKS)),
        ),
        F.coalesce(F.transform(F.array_except(known, have), lambda t: row(NO_TASK, t, severity="warn")), F.array()),
        F.coalesce(F.transform(F.array_except(have, known), lambda t: row(ODD_TASK, t)), F.array()),
    )
    of_document = F.when(~F.col("json"), F.array(row(NOT_JSON))).when(F.col("top").isNull(), F.array(row(NO_TOP))).otherwise(told(heads))
    documents = whole.select("file", F.inline(of_document))

    each = whole.select("file", F.explode("tasks").alias("task", "t")).filter(F.col("task").isin(*tasks)).select("file", "task", _object(F.col("t")).alias("members"))
    parts = each.select("file", "task", "members", _object(F.try_element_at("members", F.lit("summary"))).alias("summary"), F.try_variant_get(F.try_element_at("members", F.lit("items")), "$", "array<variant>").alias("items"))
    n = F.size("items")
    in_task = F.array(
        F.when(F.col("summary").isNull(), row(NO_SUMMARY, F.col("task"))),
        F.when(F.col("items").isNull(), row(NO_ITEMS, F.col("task"))),
        F.when(F.col("items").isNotNull() & (n > most), row(F.format_string(TOO_MANY, n, F.lit(most)), F.col("task"))),
        F.when(F.col("items").isNotNull() & (n < most), row(F.format_string(TOO_FEW, n, F.lit(most)), F.col("task"), severity="warn")),
    )
    of_task = F.when(F.col("members").isNull(), F.array(row(NO_OBJECT, F.col("task")))).otherwise(told(in_task))
    per_task = parts.select("file", F.inline(of_task))

    items = parts.select("file", "task", F.posexplode(F.slice("items", 1, most)).alias("item", "i")).select("file", "task", "item", _object(F.col("i")).alias("m"))
    wanted = F.array(*map(F.lit, ("id", "prediction", "scores")))
    lacking = F.when(F.col("m").isNull(), F.array(F.lit(NO_OBJECT))).otherwise(F.transform(F.array_except(wanted, F.map_keys("m")), lambda k: F.concat(F.lit("missing '"), k, F.lit("'"))))
    per_item = items.select("file", "task", "item", F.lit("error").alias("severity"), F.explode(lacking).alias("message"))
    return documents.unionByName(per_task).unionByName(per_item)


def audit_dump(stats: DataFrame, records: DataFrame, predictions: DataFrame, most: float = 0.10) -> DataFrame:
    """(task, id, discrimination, input, reference, predictions): items of low discrimination with their records and all predictions, best first, null scores as 0."""
    low = stats.filter(F.coalesce("discrimination", F.lit(0.0)) < most)
    answers = predictions.groupBy("task", "id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), "model", "prediction")), asc=False).alias("predictions"))
    return low.join(records.select("id", "input", "reference"), "id", "left").join(answers, ["task", "id"], "left").select("task", "id", "discrimination", "input", "reference", "predictions")


def repaired_candidates(records: DataFrame, definitions: DataFrame, table: dict[str, str] | None = None, longest: int = 8) -> DataFrame:
    """Flagged circular glosses with a candidate from a dictionary (char, content, seq: the first entry counts), or blocked."""
    flagged = records.filter(F.coalesce(F.col("metadata")[ISSUE], F.lit("")).startswith("circular gold"))
    heads = first_by(definitions, ["char"], [F.col("seq")]).select(F.col("char").alias("_char"), "content")
    joined = flagged.join(heads, F.col("metadata")["char"] == F.col("_char"), "left").withColumn("_head", X.definition_head(F.col("content"), table))
    good = F.coalesce(F.char_length("_head") <= longest, F.lit(False))
    char = F.coalesce(F.col("metadata")["char"], F.lit(""))
    return joined.select(
        "id",
        "task",
        "instruction",
        "input",
        F.when(good, F.col("_head")).otherwise(F.col("reference")).alias("reference"),
        F.map_filter("metadata", lambda k, _: k != ISSUE).alias("metadata"),
        F.when(good, "candidate").otherwise("blocked").alias("_status"),
        F.when(good, F.format_string(CANDIDATE_FROM, char, F.left("content", F.lit(40)))).when(char == "", NO_CHARACTER).otherwise(F.format_string(NO_CANDIDATE, char)).alias("_provenance"),
        F.when(good, REVIEW).otherwise(BY_HAND).alias("_needs"),
    )


def quote_overlap(records: DataFrame, task: str = "idiom-source", quote: str = "expected_quote") -> DataFrame:
    """(id, overlap): the share of an input's distinct characters that its expected quote has, 0 without a quote."""
    given, wanted = (F.array_distinct(F.array_remove(F.split(c, ""), "")) for c in (F.col("input"), F.coalesce(F.col("metadata")[quote], F.lit(""))))
    return records.filter(F.col("task") == task).select("id", (F.size(F.array_intersect(given, wanted)) / F.greatest(F.size(given), F.lit(1))).alias("overlap"))


def source_balance(records: DataFrame, source: Column, most: float = 0.5) -> DataFrame:
    """(task, source, n, share, dominant): how a task's records are spread over their sources; one with over ``most`` of them dominates."""
    counted = records.groupBy("task", source.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("task"))
    return counted.withColumn("share", F.round(share, 4)).withColumn("dominant", share > most)
