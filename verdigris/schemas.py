"""Explicit schemas of the benchmark's records and documents; nothing is inferred."""

from pyspark.sql import types as T

# The fields of the benchmark's files, down to TRIPLE.
TEXT, MAP = T.StringType(), T.MapType(T.StringType(), T.StringType())


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, TEXT) for n in names]


RECORD = T.StructType([*_strings("id", "task", "instruction", "input", "reference"), T.StructField("metadata", MAP)])
CANDIDATE = T.StructType([*RECORD.fields, *_strings("_status", "_provenance", "_needs")])
SCORES = T.MapType(T.StringType(), T.DoubleType())
ITEM = T.StructType([*_strings("id", "input", "reference", "prediction"), T.StructField("scores", SCORES)])
TASK_RESULT = T.StructType([T.StructField("task", TEXT), T.StructField("n", T.IntegerType()), T.StructField("errors", T.IntegerType()), T.StructField("elapsed_sec", T.DoubleType()), T.StructField("summary", SCORES), T.StructField("items", T.ArrayType(ITEM))])
RESULT = T.StructType([*_strings("model", "base_url", "started_at", "last_updated_at"), T.StructField("tasks", T.MapType(T.StringType(), TASK_RESULT))])
JUDGEMENT = T.StructType([*_strings("model", "task", "id"), T.StructField("chrf", T.DoubleType()), T.StructField("judge", T.IntegerType()), *_strings("judge_raw", "prediction", "reference", "input")])
PASSAGE = T.StructType(_strings("source", "chapter", "content"))
PAIR = T.StructType([*_strings("task", "input", "output", "source", "category"), T.StructField("_has_box", T.BooleanType())])
IDIOM = T.StructType([*_strings("word", "explanation"), T.StructField("source", T.StructType(_strings("text", "book")))])
DEFINITION = T.StructType(_strings("char", "content"))
QUESTION = T.StructType(_strings("question_id", "source_config", "question", "A", "B", "C", "D", "correct_letter"))
SCENARIO = T.StructType(_strings("idiom", "gloss", "idiom_prompt", "literal_prompt", "question"))
VERDICT = T.StructType(_strings("idiom", "model", "judge", "winner", "winner_raw", "ordering", "reason"))
TRIPLE = T.StructType(_strings("classical", "modern", "english", "source", "category"))

#: Tasks and the metric that ranks each.
HEADLINE = {"translate": "chrf", "punctuate": "punct_f1", "char-gloss": "chrf", "idiom-source": "book_em", "fill-in": "exact_match", "compress": "efficiency"}
TASKS = tuple(HEADLINE)
ITEMS_PER_TASK = 100
