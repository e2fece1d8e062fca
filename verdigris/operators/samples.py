"""Samples, first and last rows, and dataset builders; every order is by a seeded hash, so reruns agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions import text as X
from verdigris.sources.endpoint import Client, Settings, predictions
from verdigris.tables import small


def drawn(seed: int, *keys: str) -> Column:
    """The place of a row in a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of the table has it."""
    while name in df.columns:
        name += "_"
    return name


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key, with all columns of the table, whatever their names."""
    place = unused(df, "_n")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n).drop(place)


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return first_by(df, keys, [F.col(seq).desc()])


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return first_by(df, keys, [F.col(seq).asc()])


def answered(df: DataFrame, answer: str, error: str | None = None, failed: str = "__ERR__") -> DataFrame:
    """Rows with an answer: neither null nor empty, not marked as failed, and without an error."""
    good = (F.coalesce(F.col(answer), F.lit("")) != "") & ~F.coalesce(F.col(answer), F.lit("")).startswith(failed)
    return df.filter(good & F.col(error).isNull() if error is not None else good)


def members(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys a table has."""
    return df.join(table.select(*keys).distinct(), keys, "left_semi")


def selected(items: DataFrame, tasks: list[str] | None = None, models: list | None = None, limit: int | None = None, order: str = "ord") -> DataFrame:
    """What a run is asked for: some tasks, some models, and the first items of each; None takes all."""
    for column, wanted in (("task", tasks), ("model", models)):
        items = items if wanted is None else items.filter(F.col(column).isin(*wanted))
    return items if limit is None else first_by(items, ["model", "task"], [F.col(order)], limit)


def simple(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(drawn(seed, key), key).limit(n)


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum, all of smaller ones."""
    return least_drawn(df, stratum, key, F.lit(n), n, seed)


#: Rows of a stratum up to which Spark keeps the first ones of each partition before it shuffles.
FEW = 1000


def least_drawn(df: DataFrame, stratum: str, key: str, n: Column, most: int, seed: int = 42, place: str | None = None) -> DataFrame:
    """The first ``n`` rows of each stratum in its seeded shuffle, ``most`` at most; with their place under that name, if one is given.

    No stratum is sorted whole. For few rows Spark's own limit of windows keeps the first ones of every partition, which merge. For more, a
    count of each stratum gives the hash below which its first rows lie, with room to spare, and only those go on; where chance
    leaves fewer than are wanted, a stratum has its limit lifted.
    """
    if most > FEW:
        hashed, size, near, lift, of = (unused(df, c) for c in ("_hash", "_size", "_near", "_lift", "_of"))
        room = most + 6 * int(most**0.5) + 20
        placed = df.withColumn(hashed, F.conv(F.substring(drawn(seed, key), 1, 12), 16, 10).cast("long"))
        sizes = placed.groupBy(F.col(stratum).alias(of)).agg(F.count(F.lit(1)).alias(size))
        marked = placed.join(small(sizes), F.col(stratum).eqNullSafe(F.col(of))).drop(of).withColumn(near, F.col(hashed) < F.lit(float(room)) / F.col(size) * F.lit(float(16**12)))
        short = marked.groupBy(F.col(stratum).alias(of)).agg(F.count_if(near).alias("left"), F.max(size).alias("whole")).filter(F.col("left") < F.least(F.lit(most), F.col("whole"))).select(of, F.lit(True).alias(lift))
        lifted = marked.join(small(short), F.col(stratum).eqNullSafe(F.col(of)), "left")
        df = lifted.filter(F.col(near) | F.coalesce(lift, F.lit(False))).select(df.columns)
    at = unused(df, "_n") if place is None else place
    w = Window.partitionBy(stratum).orderBy(drawn(seed, key), key)
    found = df.withColumn(at, F.row_number().over(w)).filter(F.col(at) <= most).filter(F.col(at) <= n)
    return found.drop(at) if place is None else found


def quotas(df: DataFrame, stratum: str, key: str, wanted: dict[str, int], total: int, seed: int = 42) -> DataFrame:
    """Each stratum's quota, all of smaller ones; what lacks of ``total`` comes from strata without a quota."""
    named = F.coalesce(F.col(stratum).isin(*wanted), F.lit(False))
    extra = unused(df, "_extra")
    rows = df.withColumn(extra, ~named)
    filling = rows.filter(extra).orderBy(drawn(seed, key), key).limit(total)
    if not wanted:
        return filling.drop(extra)
    n = F.coalesce(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col(stratum)], F.lit(0))
    picked = least_drawn(rows.filter(~F.col(extra)), stratum, key, n, max(wanted.values()), seed)
    # at most quotas + total rows reach this order
    return picked.unionByName(filling).orderBy(extra, drawn(seed, key), key).limit(total).drop(extra)


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """One row of each stratum in turn, until there are n."""
    place = unused(df, "_n")
    return least_drawn(df, stratum, key, F.lit(n), n, seed, place).orderBy(place, stratum).limit(n).drop(place)


def numbered(df: DataFrame, task: str, order: list[Column]) -> DataFrame:
    """``id`` task#1, task#2, ... in an order; for the few rows of a benchmark."""
    return df.withColumn("id", F.concat(F.lit(f"{task}#"), F.row_number().over(Window.orderBy(*order)).cast("string")))


def _record(df: DataFrame, task: str, instruction: str, given: Column, reference: Column, metadata: dict[str, Column], key: str, seed: int) -> DataFrame:
    made = df.withColumn("_draw", drawn(seed + 1, key))
    made = numbered(made, task, [F.col("_draw"), F.col(key)])
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return made.select("id", F.lit(task).alias("task"), F.lit(instruction).alias("instruction"), given.alias("input"), reference.alias("reference"), F.create_map(*pairs).alias("metadata"))


def build_translate(pairs: DataFrame, categories: tuple[str, ...] = ("经", "史", "子", "集"), each: int = 25, seed: int = 42) -> DataFrame:
    """Classical to modern pairs of 10 to 60 characters, so many of each category."""
    good = pairs.filter((F.col("task") == "c2m") & ~F.coalesce("_has_box", F.lit(False)) & F.char_length("input").between(10, 60) & F.col("category").isin(*categories))
    return _record(stratified(good, "category", "input", each, seed), "translate", "将下列古文翻译成现代汉语：", F.col("input"), F.col("output"), {"source": F.col("source"), "category": F.col("category")}, "input", seed)


def build_punctuate(pairs: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Texts of 30 to 200 characters without marks, sources in turn. Rows that turn out empty leave a gap in the numbers."""
    good = pairs.filter(~F.coalesce("_has_box", F.lit(False)) & F.char_length("input").between(30, 200)).withColumn("source", F.coalesce("source", F.lit("")))
    made = _record(round_robin(good, "source", "input", n, seed), "punctuate", "为下列古文添加标点：", F.trim("input"), F.trim(F.ltrim("output", F.lit(X.LEADING_NOISE))), {"source": F.col("source"), "category": F.coalesce("category", F.lit(""))}, "input", seed)
    return made.filter("input <> '' AND reference <> ''")


def build_compress(pairs: DataFrame, wanted: dict[str, int] | None = None, n: int = 100, seed: int = 42) -> DataFrame:
    """Modern to classical pairs by length and ratio, by quotas of category."""
    wanted = {"经": 25, "史": 35, "子": 25, "集": 15} if wanted is None else wanted
    m, c = X.class_length(F.col("input")), X.class_length(F.col("output"))
    sized = pairs.filter((F.col("task") == "m2c") & ~F.coalesce("_has_box", F.lit(False))).withColumns({"_m": m, "_c": c, "category": F.coalesce(F.nullif("category", F.lit("")), F.lit("?"))})
    good = sized.filter(F.col("_m").between(100, 300) & F.col("_c").between(30, F.col("_m")) & (F.col("_c") / F.greatest("_m", F.lit(1))).between(0.30, 0.75))
    ratio = F.round(F.col("_c") / F.greatest("_m", F.lit(1)), 4)
    return _record(quotas(good, "category", "input", wanted, n, seed), "compress", "将下列现代汉语压缩成等义的文言文，力求简洁，不要解释，直接输出文言文：", F.col("input"), F.col("output"), {"source": F.coalesce("source", F.lit("?")), "category": F.col("category"), "ref_ratio": ratio}, "input", seed)


def build_cloze(passages: DataFrame, sources: list[str], n: int = 100, seed: int = 42) -> DataFrame:
    """Sentences of 8 to 25 Han characters with the middle one that may be masked taken out."""
    each = passages.filter(F.col("source").isin(*sources)).select("source", F.explode(X.sentences(F.col("content"))).alias("sentence"))
    good = each.filter(F.char_length(X.only(F.col("sentence"))).between(8, 25)).withColumn("place", X.mask_place(F.col("sentence"))).filter("place IS NOT NULL").dropDuplicates(["sentence"])
    picked = simple(good, "sentence", n, seed)
    return _record(picked, "fill-in", "填入空缺的一个字：", X.masked(F.col("sentence"), F.col("place")), F.substring(F.col("sentence"), F.col("place"), F.lit(1)), {"source": F.trim("source", F.lit("·")), "context": F.col("sentence")}, "sentence", seed)


def build_gloss(entries: DataFrame, modern: tuple[str, ...], n: int = 100, seed: int = 42) -> DataFrame:
    """Characters with a quote that has them and a short gloss, from a nested dictionary; the first quote of each gloss, and each (character, gloss) once."""
    flat = entries.filter(F.col("char").rlike(f"^[{X.HAN}]$") & (F.instr(F.lit(X.FUNCTION_WORDS), F.col("char")) == 0))
    flat = flat.select("char", F.posexplode("pronunciations").alias("_p", "p")).select("char", "_p", F.posexplode("p.explanations").alias("_e", "e")).select("char", "_p", "_e", X.plain_gloss(F.col("e.content")).alias("gloss"), F.posexplode("e.detail").alias("_d", "d"))
    quote, book = F.col("d.text"), F.coalesce("d.book", F.lit(""))
    old = F.lit(True)
    for name in modern:
        old = old & ~book.contains(name)
    good = flat.filter(F.char_length("gloss").between(2, 30) & F.char_length(quote).between(10, 80) & quote.contains(F.col("char")) & old)
    one = first_by(good, ["char", "_p", "_e"], [F.col("_d")])
    one = first_by(one, ["char", "gloss"], [F.col("_p"), F.col("_e")]).select("char", "gloss", quote.alias("quote"), book.alias("book"), F.concat_ws("|", "char", "gloss").alias("_key"))
    return _record(simple(one, "_key", n, seed), "char-gloss", "解释句中指定字的含义：", F.format_string("字：%s\n出处：%s", "char", "quote"), F.col("gloss"), {c: F.col(c) for c in ("char", "quote", "book")}, "_key", seed)


def build_idiom_source(idioms: DataFrame, books: list[str], n: int = 100, seed: int = 42) -> DataFrame:
    """Idioms of 3 to 10 characters whose source quotes a known book."""
    named = idioms.withColumn("_book", X.quoted_book(F.col("source.book"))).filter(F.col("_book").isin(*books) & F.char_length("word").between(3, 10) & F.char_length("source.text").between(8, 100))
    return _record(simple(named, "word", n, seed), "idiom-source", "指出成语的出处：", F.col("word"), F.format_string("出自《%s》：「%s」", "_book", "source.text"), {"book": F.col("_book"), "book_full": F.col("source.book"), "expected_quote": F.col("source.text"), "explanation": F.col("explanation")}, "word", seed)


def token_triples(pairs: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    good = pairs.filter((F.col("task") == "m2c") & ~F.coalesce("_has_box", F.lit(False)) & F.char_length("output").between(40, 150) & F.char_length("input").between(60, 300))
    return simple(good, "input", n, seed).select(F.col("output").alias("classical"), F.col("input").alias("modern"), F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("category", F.lit("?")).alias("category"))


def with_english(triples: DataFrame, make_client: Callable[[], Client], template: str = "{modern}", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Triples with their English side: one that is there stays, others are asked for."""
    have = triples if "english" in triples.columns else triples.withColumn("english", F.lit(None).cast("string"))
    lacking = have.filter(F.coalesce("english", F.lit("")) == "").drop("english").withColumn("_prompt", X.filled(template, modern=F.col("modern")))
    asked = predictions(lacking, make_client, "_prompt", settings).withColumn("english", F.col("prediction")).select(have.columns)
    return have.filter(F.coalesce("english", F.lit("")) != "").unionByName(asked)
