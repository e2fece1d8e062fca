"""Filter interaction audit: what every filter of a cascade removes in every order, from one histogram of failures.

Native expressions mark which of five filters a document fails, each filter on its own, as a mask of five bits. An order of the
filters removes a document at the first of its bits, so the masks' histogram, 32 cells for each part, has all that any order's counts
need: the 120 orders are enumerated from cells, and documents are read once.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.store import release, small, stored

NAMES = "ABCDE"


def word_list(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text. One-character splits need no regular expression."""
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def failures(text: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3, signs: str = "[#$%&*|]") -> Column:
    """The bits of filters A to D (1, 2, 4, 8) that a text fails: few words, few distinct words of 100, more capitals of 100 characters, any sign."""
    text = F.coalesce(text, F.lit(""))
    # a list of one element binds the words once for the three uses
    counts = F.transform(F.array(word_list(text)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    bits = F.transform(
        F.array(counts),
        lambda c: F.when(c["n"] < least_words, 1).otherwise(0) + F.when(100 * c["distinct"].cast("long") < least_distinct * c["n"].cast("long"), 2).otherwise(0),
    )[0]
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > most_capitals * F.char_length(text).cast("long")
    return bits + F.when(capitals, 4).otherwise(0) + F.when(text.rlike(signs), 8).otherwise(0)


def masks(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail which filters.

    Bit 16 is E, a text that a smaller id has too. Texts stay where they are: their digests are grouped for the smallest id,
    and a row passes E if it has it, found by digest and id together, so that no text, however often it occurs, is a hot key.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(sha).alias("sha"), failures(F.col(text_col)).alias("mask"))
    light = stored(rows.groupBy("id", "sha", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "filter-light")
    firsts = light.filter("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    later = light.join(firsts, ["sha", "id"], "left")
    fails = F.col("id").isNotNull() & F.col("first").isNull()
    marked = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    known = later.join(marked, "id", "left")
    mask = F.col("mask") + F.when(fails, 16).otherwise(0)
    found = known.groupBy("part", mask.cast("int").alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))
    found = stored(found, "filter-cells")
    release(light)
    return found


def orders(spark) -> DataFrame:
    """(filter_order, step, bit, before): the filter of each step as a bit, and the bits of those before it; 600 rows."""
    rows = []
    for order in permutations(range(len(NAMES))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(NAMES[j] for j in order), step, 1 << k, before))
            before |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def interactions(cells: DataFrame) -> DataFrame:
    """One row for every part, order and step, from ``masks``: kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley, a filter's removed documents summed over all orders.

    A part's 32 cells become one row of totals for each (bit, set of filters before it), 80 a part, by
    sums over the cells; orders only pick from them.
    """
    steps = orders(cells.sparkSession)
    bits = [1 << k for k in range(len(NAMES))]
    states = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit in bits for before in range(1 << len(NAMES)) if not before & bit])
    has, passed = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    add = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    per_state = cells.select("*", F.inline(states)).groupBy("part", "bit", "before").agg(
        add(passed & ~has).alias("kept"),
        add(passed & has).alias("removed"),
        add(~passed & has).alias("redundant"),
        add(F.col("mask") == F.col("bit")).alias("unique_fails"),
        add(passed & has & F.col("good")).alias("good_lost"),
        add(passed & has & F.col("toxic")).alias("toxic_lost"),
    )
    uses = steps.groupBy("bit", "before").agg(F.count(F.lit(1)).alias("uses"))
    shapley = per_state.join(F.broadcast(uses), ["bit", "before"]).groupBy(F.col("part").alias("_part"), F.col("bit").alias("_bit")).agg(F.sum(F.col("removed") * F.col("uses")).alias("shapley"))
    with_shapley = per_state.join(small(shapley), (F.col("part") == F.col("_part")) & (F.col("bit") == F.col("_bit"))).drop("_part", "_bit")
    out = with_shapley.join(F.broadcast(steps), ["bit", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``interactions`` of the five filters on documents and their labels (doc_id, quality, toxic).

    Null texts are empty and fail A; null parts are the part of the empty string; a row without an id is no
    copy of another. Rows that repeat an id and text have no smaller id, so they pass E alike. Of an id's several labels one of 1 is enough.
    Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    return interactions(masks(df, labels, id_col, text_col, part_col))
