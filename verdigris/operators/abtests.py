"""Paired and versioned experiments: prompt versions, A/B verdicts, token ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.stats import medians, same
from verdigris.operators.samples import first_by
from verdigris.tables import small


def version_accuracy(rows: DataFrame, versions: list[str]) -> DataFrame:
    """(model, version, n, n_ok, accuracy, prompt_chars, output_chars) over rows without an error; accuracy over all rows that answered."""
    ok = F.col("error").isNull()
    return rows.filter(F.col("version").isin(*versions)).groupBy("model", "version").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.avg(F.when(ok, F.col("is_correct").cast("int"))), 4).alias("accuracy"), F.round(F.avg(F.when(ok, F.col("prompt_chars"))), 2).alias("prompt_chars"), F.round(F.avg(F.when(ok, F.col("output_chars"))), 2).alias("output_chars")
    )


def version_deltas(accuracy: DataFrame, base: str, others: list[str]) -> DataFrame:
    """(version, n_models, delta_pp, chars_saved_pct): the mean over models of each version's gain in points and saving in characters against ``base``."""
    wide = accuracy.groupBy("model").pivot("version", [base, *others]).agg(F.first("accuracy").alias("acc"), F.first("prompt_chars").alias("chars"))
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), (100 * (F.col(f"{v}_acc") - F.col(f"{base}_acc"))).alias("pp"), (100 * (1 - F.col(f"{v}_chars") / F.nullif(F.col(f"{base}_chars"), F.lit(0.0)))).alias("saved")) for v in others]))
    return wide.select(rows.alias("d")).select("d.*").groupBy("version").agg(F.count("pp").alias("n_models"), F.round(F.avg("pp"), 4).alias("delta_pp"), F.round(F.avg("saved"), 4).alias("chars_saved_pct"))


def paired(runs: DataFrame, keys: list[str], version: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """(keys..., column_first, column_second, ...) where both versions are there."""
    wide = runs.groupBy(*keys).pivot(version, [first, second]).agg(*[F.first(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_n"))
    return wide.filter(F.col(f"{first}__n").isNotNull() & F.col(f"{second}__n").isNotNull()).select(*keys, *[F.col(f"{v}_{c}").alias(f"{c}_{v}") for c in columns for v in (first, second)])


def verdict(raw: Column, first_is_a: Column, first: str = "idiom", second: str = "literal") -> Column:
    """The winner behind blind letters; null for anything but A, B or Tie."""
    return F.when(raw == "Tie", "tie").when(raw.isin("A", "B"), F.when((raw == "A") == first_is_a, first).otherwise(second))


def win_rates(verdicts: DataFrame, by: list[str], first: str = "idiom", second: str = "literal") -> DataFrame:
    """(by..., n, wins, ties, losses, not_loss): the first version's outcomes."""
    w = F.col("winner")
    counted = verdicts.groupBy(*by).agg(F.count("winner").alias("n"), F.count_if(w == first).alias("wins"), F.count_if(w == "tie").alias("ties"), F.count_if(w == second).alias("losses"))
    return counted.withColumn("not_loss", F.round((F.col("wins") + F.col("ties")) / F.nullif(F.col("n"), F.lit(0)), 4))


def pair_ratios(pairs: DataFrame, by: list[str], numerator: str, denominator: str) -> DataFrame:
    """(by..., n, ratio_mean, ratio_median, saved_pct): the mean and median of each pair's ratio, and the saving that the mean stands for."""
    ratio = F.col(numerator) / F.nullif(F.col(denominator).cast("double"), F.lit(0.0))
    rated = pairs.select(*by, ratio.alias("_r")).filter("_r IS NOT NULL")
    middle = medians(rated, "_r", by, "_median")
    out = same(rated.groupBy(*by).agg(F.avg("_r").alias("_m")), middle, by)
    return out.select(*by, "n", F.round("_m", 4).alias("ratio_mean"), F.round("_median", 4).alias("ratio_median"), F.round((1 - 1 / F.nullif(F.col("_m"), F.lit(0.0))) * 100, 4).alias("saved_pct"))


def decision(ratio_saving: Column, not_loss: Column, least_saving: float = 0.20) -> Column:
    """Whether a shorter version pays: it must save enough and not lose more often than it holds."""
    return F.when(ratio_saving < least_saving, "no saving").when(not_loss >= 0.7, "adopt").when(not_loss >= 0.5, "trade-off").otherwise("reject")


def grid(*lists: DataFrame) -> DataFrame:
    """Every combination of rows of some short lists, such as models, versions and questions: the work of an experiment.
    All but the first are broadcast where a count shows that they are short."""
    out = lists[0]
    for other in lists[1:]:
        out = out.crossJoin(small(other))
    return out


def with_lookup(rows: DataFrame, found: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Rows with the columns of their scenario or question. ``strict``: a row whose key isn't there is an error, else it goes."""
    if strict and not (lost := rows.join(found.select(key).distinct(), key, "left_anti")).isEmpty():
        raise KeyError(f"{key}: {lost.first()[key]}")
    return rows.join(small(found), key)


def top_savings(pairs: DataFrame, by: list[str], key: str, long: str, short: str, n: int = 5) -> DataFrame:
    """(by..., key, ratio): the n pairs whose long side is the most times its short one, equal ones by key."""
    ratio = F.col(long) / F.nullif(F.col(short).cast("double"), F.lit(0.0))
    return first_by(pairs.withColumn("ratio", ratio).filter("ratio IS NOT NULL"), by, [F.col("ratio").desc(), F.col(key)], n).select(*by, key, "ratio")


def report(pairs: DataFrame, verdicts: DataFrame, by: list[str], long: str, short: str) -> DataFrame:
    """(by..., n, ratio_mean, ratio_median, saved_pct, judged, wins, ties, losses, not_loss, decision): savings and outcomes side by side."""
    ratios = pair_ratios(pairs, by, long, short)
    won = win_rates(verdicts, by).withColumnRenamed("n", "judged")
    return ratios.join(won, by, "left").withColumn("decision", decision(F.col("saved_pct") / 100, F.col("not_loss")))
