"""Token counts by pluggable tokenizers, and density tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Counter = Callable[[Column], Column]

#: Tokenizers that need no vocabulary.
BUILT_IN: dict[str, Counter] = {
    "chars": lambda c: F.char_length(c).cast("long"),
    "bytes": lambda c: F.octet_length(c).cast("long"),
    "words": lambda c: F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
}


def counter(load: Callable[[], Callable[[str], int]]) -> Counter:
    """A tokenizer from Python as a counter; ``load`` runs once in each worker."""
    held: list[Callable[[str], int]] = []

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return values.map(lambda s: None if s is None else held[0](s))

    return run


def registry(extra: dict[str, Callable[[], Callable[[str], int]]]) -> dict[str, Counter]:
    """The built-in tokenizers and those of ``extra`` that load here; others are left out."""
    found = dict(BUILT_IN)
    for name, load in extra.items():
        try:
            load()
        except Exception:  # noqa: BLE001  whatever keeps a tokenizer from loading
            continue
        found[name] = counter(load)
    return found


def token_counts(df: DataFrame, keys: list[str], variants: list[str], tokenizers: dict[str, Counter] = BUILT_IN) -> DataFrame:
    """(keys..., tokenizer, variant, chars, tokens), one row for each tokenizer and variant column."""
    cells = [F.struct(F.lit(t).alias("tokenizer"), F.lit(v).alias("variant"), F.char_length(v).cast("long").alias("chars"), count(F.col(v)).alias("tokens")) for t, count in tokenizers.items() for v in variants]
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def density(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, tokens_mean, chars_per_token): a mean of counts and a ratio of sums."""
    return counts.groupBy(*by).agg(F.count("tokens").alias("n"), F.round(F.avg("tokens"), 4).alias("tokens_mean"), F.round(F.sum("chars") / F.nullif(F.sum("tokens").cast("double"), F.lit(0.0)), 4).alias("chars_per_token"))


def variant_ratios(table: DataFrame, variants: list[str], base: str) -> DataFrame:
    """(tokenizer, variant_vs_base...): ratios of means, rounded to 3 places."""
    wide = table.groupBy("tokenizer").pivot("variant", variants).agg(F.first("tokens_mean"))
    return wide.select("tokenizer", *[F.round(F.col(v) / F.nullif(F.col(base), F.lit(0.0)), 3).alias(f"{v}_vs_{base}") for v in variants if v != base])


def ranked(table: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by..., tokenizer, value, place, best, worst): tokenizers by a ratio, the least first, with the names at both ends; equal ones by name."""
    groups = list(by)
    order = F.struct(value, "tokenizer")
    ends = table.groupBy(*groups).agg(F.min_by("tokenizer", order).alias("best"), F.max_by("tokenizer", order).alias("worst"))
    placed = table.select(*groups, "tokenizer", value, F.row_number().over(Window.partitionBy(*groups).orderBy(value, "tokenizer")).alias("place"))
    return placed.join(ends, groups) if groups else placed.crossJoin(F.broadcast(ends))  # one row
