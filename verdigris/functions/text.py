"""Text functions as Column expressions; code points are the unit of length.

The character classes that are special to classical Chinese are parameters, so that the same functions serve other scripts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character sets and names of the benchmark.
PUNCTUATION = "，。：；、！？「」『』《》（）()【】“”‘’,.;:!?\"'-—…"
BOOK_MARKS = "《》「」『』\"\"''（）()【】 \t\n"
SHINGLE_MARKS = "，。、；：！？「」『』《》（）()【】“”‘’,.;:!?\"'-—…"
SENTENCE_MARKS = "，。：；、！？「」『』《》（）()【】 　“”‘’\n"
LEADING_NOISE = "，。：；、！？「」『』《》（）()【】 　"
FUNCTION_WORDS = "之乎者也而其以为与于焉夫且乃则若所是非有无可不"
CLAUSE_MARKS = "，。、；：！？"
BUILT_MARKS = ("从", "從", "凡", "《", "讀若", "读若", "聲", "声", "象")
HAN = "一-鿿"
HAN_WIDE = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}"
BOOK_ALIASES = {
    "老子": ["道德经"],
    "庄子": ["南华经", "南华真经"],
    "史记": ["太史公书"],
    "汉书": ["前汉书"],
    "周易": ["易经"],
    "尚书": ["书经"],
    "诗经": ["毛诗"],
    "左传": ["左氏春秋", "春秋左氏传", "左氏传"],
    "公羊传": ["春秋公羊传"],
    "穀梁传": ["春秋穀梁传", "谷梁传", "春秋谷梁传"],
}


def let(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` of values that are computed once for a row, however often it names them.

    The optimizer puts an expression in the place of each of its names, in lambdas too, where it is then computed for
    every element; the variable of a lambda over an array of one value is not replaced.
    """
    held = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(held, lambda x: body(*[x[k] for k in values])), F.lit(0))


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition; no built-in function has it."""
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def squeeze(text: Column) -> Column:
    """Without any white space, of Unicode too. Null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def strip_text(text: Column, compose: bool = True) -> Column:
    """What scorers compare: composed and without white space. ``compose``: False stays inside the JVM."""
    return squeeze(nfkc(F.coalesce(text, F.lit("")))) if compose else squeeze(text)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def only(text: Column, characters: str = HAN) -> Column:
    """Characters of a class only."""
    return F.regexp_replace(text, f"[^{characters}]", "")


def class_length(text: Column, characters: str = HAN_WIDE) -> Column:
    return F.char_length(only(text, characters))


def convert(text: Column, table: dict[str, str] | None) -> Column:
    """One-to-one characters, such as traditional to simplified; identity without a table."""
    return F.translate(text, "".join(table), "".join(table.values())) if table else text


def grams(text: Column, n: int | Column) -> Column:
    """All runs of n characters, an empty array for shorter texts."""
    size = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.char_length(text) >= size, F.sequence(F.lit(1), F.char_length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, size))


def book_name(text: Column, table: dict[str, str] | None = None, marks: str = BOOK_MARKS) -> Column:
    return without(convert(text, table), marks)


def book_hit(prediction: Column, book: Column, aliases: dict[str, list[str]] = BOOK_ALIASES, table: dict[str, str] | None = None, marks: str = BOOK_MARKS) -> Column:
    """Whether a book's name or an alias of it is in the prediction, all without ``marks``; an empty name always is."""
    p = book_name(prediction, table, marks)
    hit = p.contains(book_name(book, table, marks))
    for name, others in aliases.items():
        for other in others:
            hit = hit | ((book == name) & p.contains(book_name(F.lit(other), table, marks)))
    return hit


def quoted_or_first(text: Column, characters: str = HAN) -> Column:
    """The quoted single character of a class, else the first one, else empty."""
    quoted = F.regexp_extract(text, f"[「『\"'‘“]([{characters}])[」』\"'’”]", 1)
    return F.when(quoted != "", quoted).otherwise(F.substring(only(text, characters), 1, 1))


def first_digit(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, "[0-5]", 0), F.lit("")).cast("int")


def choice_letter(raw: Column) -> Column:
    """A-D of a reply: its first character behind marks, in either case, else a lone letter anywhere."""
    head = F.upper(F.substring(F.ltrim(F.trim(raw), F.lit("`'\"*# \t\n")), 1, 1))
    lone = F.regexp_extract(F.upper(raw), r"\b([ABCD])\b", 1)
    return F.when(head.isin("A", "B", "C", "D"), head).otherwise(F.nullif(lone, F.lit("")))


def without_fence(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-z]*\n?", ""), r"\n?```$", "")


def braces(raw: Column) -> Column:
    """From the first opening brace to the last closing one, null if there is none."""
    return F.nullif(F.regexp_extract(without_fence(raw), r"(?s)\{.*\}", 0), F.lit(""))


def plain_gloss(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"^\([^)]*\)。?", "")), r"\s+", " ")


def sentences(text: Column, stops: str = "。！？") -> Column:
    """Sentences without brackets' content and white space."""
    parts = F.split(text, f"[{stops}]")
    clean = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "【.*?】", ""), "[（(].*?[)）]", ""), r"(?U)\s+", "")
    return F.transform(parts, clean)


def mask_place(sentence: Column, characters: str = HAN, stop: str = FUNCTION_WORDS + SENTENCE_MARKS) -> Column:
    """The middle one (from 1) of the characters that may be masked: of the class, neither first nor last, no stop character, and once in the sentence; null if there is none."""
    n = F.char_length(sentence)
    inner = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))

    def good(i: Column) -> Column:
        c = F.substring(sentence, i, F.lit(1))
        return c.rlike(f"^[{characters}]$") & (F.instr(F.lit(stop), c) == 0) & (F.char_length(sentence) - F.char_length(F.replace(sentence, c)) == 1)

    places = F.filter(inner, good)
    return F.when(F.size(places) > 0, F.get(places, F.floor(F.size(places) / 2).cast("int")))


def masked(sentence: Column, place: Column, mask: str = "___") -> Column:
    return F.concat(F.substring(sentence, F.lit(1), place - 1), F.lit(mask), F.substring(sentence, place + 1, F.char_length(sentence)))


def quoted_book(field: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(field, "《([^《》·]+?)(?:[·、].*)?》", 1)), F.lit(""))


def source_head(source: Column) -> Column:
    """A source up to its first dot or slash."""
    return F.trim(F.regexp_extract(F.coalesce(source, F.lit("")), "^([^·/]*)", 1))


def definition_head(content: Column, table: dict[str, str] | None = None) -> Column:
    """The first clause of a dictionary entry, before what says how a character is built: without marks at either end and the particle that closes it."""
    words = "|".join(BUILT_MARKS)
    first = convert(F.regexp_extract(content, rf"(?s)^(.*?)(?:[，。]?\s*(?:{words})|$)", 1), table)
    return F.nullif(F.regexp_replace(first, rf"^[{CLAUSE_MARKS}\s]+|[{CLAUSE_MARKS}\s]*也?[{CLAUSE_MARKS}\s]*$", ""), F.lit(""))


def shingle(text: Column, size: int = 24, marks: str = SHINGLE_MARKS) -> Column:
    """What a corpus is searched for: the middle run of a text without marks and white space."""
    return middle(F.regexp_replace(without(text, marks), r"(?U)\s+", ""), size)


def middle(text: Column, size: int) -> Column:
    """The middle run of ``size`` characters, all of a shorter text."""
    n = F.char_length(text)
    return F.when(n >= size, F.substring(text, F.floor((n - size) / 2).cast("int") + 1, F.lit(size))).otherwise(text)


def occurrences(text: Column, part: Column) -> Column:
    """Occurrences that don't overlap; null for an empty part."""
    return F.when(part != "", (F.char_length(text) - F.char_length(F.replace(text, part))) / F.char_length(part)).cast("long")


def prompt(instruction: Column, given: Column) -> Column:
    return F.concat_ws("\n\n", instruction, given)


def choice_prompt(question: Column, *options: Column) -> Column:
    return F.concat_ws("\n", question, *[F.concat(F.lit(f"{letter}. "), o) for letter, o in zip("ABCD", options, strict=True)])


def version_prompt(version: Column, bodies: dict[str, Column], question: Column) -> Column:
    """The body of a row's version, then the question."""
    body = F.lit(None).cast("string")
    for name, column in bodies.items():
        body = F.when(version == name, column).otherwise(body)
    return F.concat_ws("\n\n", body, question)


def is_correct(raw: Column, answer: Column) -> Column:
    """Whether a reply's letter is the answer; no letter is wrong."""
    return F.coalesce(choice_letter(raw) == answer, F.lit(False))


def filled(template: str, **values: Column) -> Column:
    """A rubric with its ``{name}`` places filled, missing values as empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def file_name(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("_"))
