"""Judges: prompts, parsed scores, agreement, backfill and correlation with metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.functions.stats import kappa, pearson, spearman
from verdigris.operators.samples import first_by, last_wins
from verdigris.sources.endpoint import Client, Settings, predictions


def judge_prompt(template: str, given: Column, reference: Column, prediction: Column) -> Column:
    return X.filled(template, input=given, reference=reference, prediction=prediction)


def parsed(raw: Column) -> Column:
    """Struct of a 0-5 score and its fifth, null without a digit."""
    score = X.first_digit(raw)
    return F.struct(score.alias("judge"), (score / 5).alias("judge_norm"))


def scored(rows: DataFrame, make_client: Callable[[], Client], template: str, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Rows (input, reference, prediction, ...) with judge, judge_norm, judge_raw and judge_error: a judge's reply to the filled
    template. A failed call and a reply without a digit are asked again; null scores are what stays without one."""
    asked = rows.withColumn("_prompt", judge_prompt(template, F.col("input"), F.col("reference"), F.col("prediction"))).withColumnRenamed("prediction", "_given")
    answered = predictions(asked, make_client, "_prompt", settings, accept=lambda reply: any(c in "012345" for c in reply))
    score = parsed(F.col("prediction"))
    found = answered.withColumns({"judge": score["judge"], "judge_norm": score["judge_norm"], "judge_raw": F.col("prediction"), "judge_error": F.col("error")})
    return found.select(*[F.col("_given").alias("prediction") if c == "prediction" else F.col(c) for c in rows.columns], "judge", "judge_norm", "judge_raw", "judge_error")


def paired_logs(a: DataFrame, b: DataFrame, keys: list[str], seq: str, score: str = "judge") -> DataFrame:
    """(keys..., a, b): the scores of items that both logs have; the last row of a key counts, rows without a score don't."""
    one = lambda log, name: last_wins(log.filter(F.col(score).isNotNull()), keys, seq).select(*keys, F.col(score).alias(name))
    return one(a, "a").join(one(b, "b"), keys)


def agreement(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by..., n, kappa_quad, strict_agree, lenient_agree, bias) of two raters."""
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = (F.col(a) - F.col(b)).cast("double")
    plain = both.groupBy(*by).agg(F.round(F.avg((d == 0).cast("int")), 4).alias("strict_agree"), F.round(F.avg((F.abs(d) <= 1).cast("int")), 4).alias("lenient_agree"), F.round(F.avg(d), 4).alias("bias"))
    return kappa(both, a, b, by).withColumn("kappa", F.round("kappa", 4)).withColumnRenamed("kappa", "kappa_quad").join(plain, by)


def model_agreement(pairs: DataFrame, by: list[str], model: str = "model", a: str = "a", b: str = "b") -> DataFrame:
    """(by..., n_models, spearman) of the raters' means by model."""
    means = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, model).agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    return spearman(means, "mean_a", "mean_b", by, least=2, nan=True, name="spearman").withColumnRenamed("n", "n_models")


def high_disagreement(pairs: DataFrame, least: int = 3, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.withColumn("diff", F.col(a) - F.col(b)).filter(F.abs("diff") >= least)


def metric_correlation(rows: DataFrame, by: list[str], metric: str = "chrf", judge: str = "judge") -> DataFrame:
    """(by..., n, pearson, spearman, metric_mean, judge_mean_norm)."""
    both = rows.filter(F.col(metric).isNotNull() & F.col(judge).isNotNull())
    linear = both.groupBy(*by).agg(F.round(pearson(metric, judge, 2, nan=True), 4).alias("pearson"), F.round(F.avg(metric), 4).alias("metric_mean"), F.round(F.avg(F.col(judge) / 5), 4).alias("judge_mean_norm"))
    ranks = spearman(both, metric, judge, by, least=2, nan=True, name="spearman").withColumn("spearman", F.round("spearman", 4))
    return ranks.join(linear, by)


def divergence(rows: DataFrame, by: list[str], key: str, n: int = 10, metric: str = "chrf", judge: str = "judge") -> DataFrame:
    """(by..., key, divergence, side): the n rows that a metric most underrates and overrates against the judge."""
    d = rows.withColumn("divergence", F.col(judge) / 5 - F.col(metric)).filter("divergence IS NOT NULL")
    under = first_by(d, by, [F.col("divergence").desc(), F.col(key)], n).withColumn("side", F.lit("underrated"))
    over = first_by(d, by, [F.col("divergence"), F.col(key)], n).withColumn("side", F.lit("overrated"))
    return under.unionByName(over).select(*by, key, "divergence", "side")


def backfill(items: DataFrame, judged: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Items with a judge's score and its fifth under ``label`` where there is one; judged has (keys..., judge) once a key."""
    return items.join(judged.select(*keys, F.col("judge").alias(label)), keys, "left").withColumn(f"{label}_norm", F.col(label) / 5)


def backfill_summary(items: DataFrame, judged: DataFrame, label: str, by: list[str], keys: list[str]) -> DataFrame:
    """(by..., metric, value): the mean of ``label``_norm over items that have a score, and their number as ``label``_n."""
    filled = backfill(items, judged, label, keys).filter(F.col(label).isNotNull())
    means = filled.groupBy(*by).agg(F.round(F.avg(f"{label}_norm"), 4).alias("_mean"), F.count(F.lit(1)).cast("double").alias("_n"))
    rows = F.array(F.struct(F.lit(f"{label}_norm").alias("metric"), F.col("_mean").alias("value")), F.struct(F.lit(f"{label}_n").alias("metric"), F.col("_n").alias("value")))
    return means.select(*by, F.inline(rows))
