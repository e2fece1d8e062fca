"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Within a source, keys are dealt into ranges of equal width;
sums of the ranges give distributed prefix sums. The range that holds the budget's end is dealt into
ranges again until it has few rows, and only these are sorted. A source's plan is one row, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdigris.llm.store import release, small, stored

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
#: Rows of a source that one task sorts, and ranges that sources are ordered in.
SORTED, PARTS = 100_000, 64


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """60 bits of a hash of the id and a seed."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def by_code_point(sources: DataFrame) -> DataFrame:
    """Adds ``nth``, the place of a source from 0 by code point, null last: ranges of sources are numbered apart and moved by those before."""
    dealt = stored(sources.repartitionByRange(PARTS, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-sources")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.join(F.broadcast(before), "_part").withColumn("nth", within + F.col("_before")).drop("_part", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds ``target``, the words a source gives, to (source, size): one row for each source.

    Sources take ``weights`` by code point, null last. They share ``share`` times all sizes, a target
    stops at ``cap`` times its source's size, and the excess is dealt again by weight. That is a water
    level: it rises as long as sources that stop leave something to the others. Each step is a sum over
    all sources, and there are as many as times that further sources stop.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights)).cast("int") + 1)
    weighed = stored(by_code_point(sources).withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("size")), "mix-weights")
    level, before = 0.0, -1.0
    total = float(share) * (weighed.agg(F.sum("size")).first()[0] or 0)
    while level is not None and level != before:
        stops = F.col("most") <= F.lit(level) * F.col("weight")
        sums = weighed.agg(F.sum(F.when(stops, F.col("most"))), F.sum(F.when(~stops, F.col("weight")))).first()
        before, level = level, (total - (sums[0] or 0.0)) / sums[1] if sums[1] else None
    target = F.col("most") if level is None else F.least("most", F.lit(level) * F.col("weight"))
    return weighed.withColumn("target", target).drop("weight", "most", "nth")


def _ends(sums: DataFrame, bits: int) -> DataFrame:
    """(source, low, left, rows) of the range where a budget ends, of (source, low, left, range, words, rows): its first key, what is left of the budget there, and its rows."""
    along = Window.partitionBy("source").orderBy("range")  # as many rows as there are ranges
    prefix = sums.withColumn("before", F.sum("words").over(along) - F.col("words"))
    held = prefix.filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
    return held.select("source", (F.col("low") + F.shiftleft("range", bits)).alias("low"), (F.col("left") - F.col("before")).alias("left"), "rows")


def _inside(light: DataFrame, ends: DataFrame, bits: int) -> DataFrame:
    """Rows of ``light`` in the ranges of ``bits`` bits where budgets end, with low and left."""
    same = F.col("d.source").eqNullSafe(F.col("e.source")) & (F.shiftright(F.col("d.key"), bits) == F.shiftright(F.col("e.low"), bits))
    return light.alias("d").join(small(ends).alias("e"), same).select("d.source", "d.key", "d.doc_id", "d.size", "e.low", "e.left")


def plan(light: DataFrame, weights: tuple[int, ...], share: float, cap: float, range_bits: int) -> DataFrame:
    """What each source gives, from (doc_id, source, size, key): one row for each source, with
    ``full`` whole passes and one more over keys below ``cut``; rows at (cut, cut_id) share what is left, ``cut_words`` each.
    """
    counted = [F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")]
    bits = KEY_BITS - range_bits
    sums = stored(light.groupBy("source", F.shiftright("key", bits).alias("range")).agg(*counted), "mix-ranges")
    sources = sums.groupBy("source").agg(F.sum("words").alias("size"))
    budget = F.round("target").cast("long")
    goal = targets(sources, weights, share, cap).withColumns({"full": F.when(F.col("size") > 0, F.floor(budget / F.col("size"))).otherwise(0).cast("long")}).withColumn("rest", budget - F.col("full") * F.col("size"))
    goal = stored(goal, "mix-goal")
    budgets = sums.alias("s").join(small(goal).alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", F.lit(0).cast("long").alias("low"), F.col("g.rest").alias("left"), "s.range", "s.words", "s.rows")
    ends = stored(_ends(budgets, bits), "mix-ends")
    while bits and (ends.agg(F.max("rows")).first()[0] or 0) > SORTED:
        finer = max(0, bits - range_bits)
        dealt = _inside(light, ends, bits).withColumn("range", F.shiftright("key", finer) - F.shiftright("low", finer))
        ends, bits = stored(_ends(dealt.groupBy("source", "low", "left", "range").agg(*counted), finer), "mix-ends"), finer
    # equal (key, doc_id) are repeated rows: they count as one step and share it evenly
    steps = _inside(light, ends, bits).groupBy("source", "key", "doc_id", "left").agg(F.sum("size").alias("step"), F.count(F.lit(1)).alias("rows"))
    in_range = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first())
    cut = steps.withColumn("before", F.sum("step").over(in_range) - F.col("step")).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("step")))
    cut = cut.select("source", F.col("key").alias("cut"), F.col("doc_id").alias("cut_id"), F.floor((F.col("left") - F.col("before")) / F.col("rows")).cast("long").alias("cut_words"))
    joined = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
    found = stored(joined.select("g.*", "c.cut", "c.cut_id", "c.cut_words"), "mix-plan")
    release(sums, goal, ends)
    return found


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", range_bits: int = 12, keep: list[str] | None = None) -> DataFrame:
    """Adds size, source_size, target and taken (the words that the mix takes of a document, repeats counted).

    Every source's words are taken to the word: all documents ``floor(target / size)`` times, then in
    the order of their keys until the budget ends, within a document if need be. Repeated rows at that
    end share it evenly, rounded down. Null and empty texts have size 0 and nothing taken; null sources
    are a source of their own; columns named like a result are replaced; an empty table gives no rows.
    """
    results = ["size", "source_size", "target", "taken"]
    own = {c: f"own_{k}" for k, c in enumerate(df.columns)}  # no name of a column is in the way
    of = lambda c: F.col(f"`{c}`")
    sized = df.select(*[of(c).alias(name) for c, name in own.items()], of(id_col).alias("_mix_id"), of(source_col).alias("_mix_source"), words(of(text_col)).alias("_mix_size"), random_key(of(id_col), seed).alias("_mix_key"))
    if not isinstance(df.schema[id_col].dataType, T.LongType):
        sized = sized.withColumn("_mix_id", F.col("_mix_id").cast("string"))
    light = stored(sized.select(F.col("_mix_id").alias("doc_id"), F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size"), F.col("_mix_key").alias("key")), "mix-light")
    wanted = [c for c in df.columns if c not in results and (keep is None or c in keep)]
    if keep is not None and set(keep) <= {id_col}:  # no need to read texts again
        sized = light.select(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), F.col("key").alias("_mix_key"), *([F.col("doc_id").cast(df.schema[id_col].dataType).alias(own[id_col])] if keep else []))
    one = small(plan(light, weights, share, cap, range_bits)).alias("p")
    at_cut = (F.col("_mix_key") == F.col("p.cut")) & F.col("_mix_id").eqNullSafe(F.col("p.cut_id"))
    below = (F.col("_mix_key") < F.col("p.cut")) | ((F.col("_mix_key") == F.col("p.cut")) & F.when(F.col("_mix_id").isNull(), F.col("p.cut_id").isNotNull()).otherwise(F.col("p.cut_id").isNotNull() & (F.col("_mix_id") < F.col("p.cut_id"))))
    more = F.when(at_cut, F.least("p.cut_words", "_mix_size")).when(below, F.col("_mix_size")).otherwise(0)
    out = sized.alias("d").join(one, F.col("_mix_source").eqNullSafe(F.col("p.source")))
    return out.select(*[F.col(f"d.{own[c]}").alias(c) for c in wanted], F.col("_mix_size").alias("size"), F.col("p.size").alias("source_size"), F.col("p.target").alias("target"), (F.col("p.full") * F.col("_mix_size") + more).cast("long").alias("taken"))


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, from ``mix`` with texts: a row for each time that a document is taken; the copy in
    which the budget ends keeps its first words, joined by one space."""
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0)
    part = F.when(size > 0, taken % size).otherwise(0)
    n = (whole + (part > 0).cast("long")).cast("int")
    each = mixed.filter(n > 0).select(F.struct(*[F.col(f"`{c}`") for c in mixed.columns]).alias("row"), F.explode(F.sequence(F.lit(1), n)).alias("copy"), whole.alias("whole"), part.alias("part"))
    row, part = F.col("row").getField, F.col("part")
    head = F.array_join(F.slice(F.regexp_extract_all(row(text_col), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(part, F.lit(1)).cast("int")), " ")
    cut = (F.col("copy") > F.col("whole")) & (part > 0)
    return each.select(*[(F.when(cut, head).otherwise(row(c)) if c == text_col else row(c)).alias(c) for c in mixed.columns])
