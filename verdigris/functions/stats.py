"""Rank, correlation and agreement statistics that behave alike in degenerate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows up to which one task sorts a group, rows of a range in larger groups, and ranges at most.
SORTED, IN_RANGE, RANGES = 1_000_000, 500_000, 2000


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of the same names that takes nulls for equal; the keys of ``b`` go."""
    renamed = b.select([F.col(c).alias(f"_b_{c}") if c in keys else F.col(c) for c in b.columns])
    joined = a
    on = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in keys]
    joined = joined.join(renamed, on, how)
    return joined.drop(*[f"_b_{c}" for c in keys])


def largest(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def average_ranks(df: DataFrame, value: str, by: list[str], name: str, rows: int | None = None) -> DataFrame:
    """(by..., value, name) for every distinct number of a group: its rank from 1, ties sharing the mean of their places.

    Values are counted before they are shuffled. Groups of at most SORTED rows (``rows``: those of the largest, if the caller has counted
    them) are numbered by one window. For larger ones approximate quantiles deal a group's values into ranges, in
    order, as many as its rows ask for, so that a rank is the sum of the ranges before, a few rows a group, and of counts within its
    range: no task sorts a whole group. The cuts may lie anywhere; ranks are exact.
    """
    rows = largest(df, by) if rows is None else rows
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if rows <= SORTED:
        before = F.sum("_n").over(Window.partitionBy(*by).orderBy(value)) - F.col("_n")
        return counted.select(*by, value, (before + (F.col("_n") + 1) / 2).alias(name))
    ranges = min(RANGES, -(-rows // IN_RANGE) + 1)
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("_cuts"))
    dealt = same(counted, cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    before = sums.select(*by, "_range", (F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_sum")).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy(value)) - F.col("_n")
    return same(dealt, before, [*by, "_range"]).select(*by, value, (F.col("_before") + within + (F.col("_n") + 1) / 2).alias(name))


def _pair_ranks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of both columns in one exchange: a row's rank is that of the first equal one, and half of the others that are equal."""
    rank = lambda v: F.rank().over(Window.partitionBy(*keys).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, v)) - 1) / 2
    return pairs.select(*keys, rank("_vx").alias("_x"), rank("_vy").alias("_y"))


def medians(df: DataFrame, value: str, by: list[str], name: str, error: int = 10_000, most: int = SORTED) -> DataFrame:
    """(by..., n, name): the exact median of each group's numbers, the mean of the middle two of an even count; nulls are left out.

    Selection by ranges: an approximate quantile on either side of the middle, whose errors are bounded, brackets it. What is below is
    only counted, and what is inside is selected again until the largest group's rest has ``most`` rows, which
    are sorted. Every step keeps about 4 of ``error`` rows, so no task holds the values of a whole group.
    """
    keys = by or ["_all"]
    known = (df if by else df.withColumn("_all", F.lit(1))).filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    rows = counts.agg(F.max("_total")).first()[0] or 0
    # _rest rows lie inside, _below of all _total before them
    inside = same(known, counts, keys).withColumns({"_below": F.lit(0).cast("long"), "_rest": F.col("_total")})
    while rows > most:
        middle = lambda shift: (F.floor((F.col("_total") - 1) / 2) + shift - F.col("_below")) / F.col("_rest")
        sketch = inside.groupBy(*keys, "_total", "_below", "_rest").agg(F.percentile_approx("_v", [k / 1000 for k in range(1001)], error).alias("_q"))
        # the sketch's ranks are off by 1 of ``error`` at most, its places lie 1 of 1000 apart
        at = lambda c, places: F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(c * 1000).cast("int") + places))
        cuts = sketch.select(*keys, F.get("_q", at(middle(0), -2)).alias("_lo"), F.get("_q", at(middle(1), 3)).alias("_hi"))
        dealt = same(inside, cuts, keys)
        under = dealt.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_under"), F.count_if(F.col("_v").between(F.col("_lo"), F.col("_hi"))).alias("_left"), F.countDistinct(F.when(F.col("_v").between(F.col("_lo"), F.col("_hi")), F.col("_v"))).alias("_kinds"))
        narrowed = same(dealt.filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))), under, keys)
        inside = narrowed.select(*keys, "_v", "_total", (F.col("_below") + F.col("_under")).alias("_below"), F.col("_left").alias("_rest"))
        left = under.agg(F.max(F.least("_left", "_kinds"))).first()[0]
        if left >= rows:
            break
        rows = left
    counted = inside.groupBy(*keys, "_total", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    up_to = counted.withColumn("_up_to", F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")))
    first = lambda k: F.min(F.when(F.col("_up_to") > F.floor((F.col("_total") - k) / 2), F.col("_v")))
    return up_to.groupBy(*keys).agg(F.max("_total").alias("n"), ((first(1) + first(0)) / 2).alias(name)).drop("_all")


def pearson(x: str, y: str, least: int = 3, nan: bool = False) -> Column:
    """Aggregate: population correlation, null (or NaN) for fewer than ``least`` pairs or no variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    empty = (F.count(F.when(both, 1)) < least) | (F.var_pop(a) <= 0) | (F.var_pop(b) <= 0)
    return F.when(empty, F.lit(float("nan") if nan else None).cast("double")).otherwise(F.covar_pop(a, b) / F.sqrt(F.nullif(F.var_pop(a) * F.var_pop(b), F.lit(0.0))))


def spearman(df: DataFrame, x: str, y: str, by: list[str], least: int = 3, nan: bool = False, name: str = "rho") -> DataFrame:
    """(by..., n, name): Pearson over average ranks; pairs with a null take no part."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    keys = by or ["_all"]
    pairs = pairs if by else pairs.withColumn("_all", F.lit(1))
    pairs = pairs.select(*keys, F.col(x).alias("_vx"), F.col(y).alias("_vy"))
    rows = largest(pairs, keys)
    if rows <= SORTED:
        ranked = _pair_ranks(pairs, keys)
    else:
        ranked = same(same(pairs, average_ranks(pairs, "_vx", keys, "_x", rows), [*keys, "_vx"]), average_ranks(pairs, "_vy", keys, "_y", rows), [*keys, "_vy"])
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("_x", "_y", least, nan).alias(name)).drop("_all")


def kappa(df: DataFrame, a: str, b: str, by: list[str], levels: int = 6) -> DataFrame:
    """(by..., n, kappa): quadratic weighted kappa of two ordinal raters; null without rows or spread.

    sum(w O) and sum(w E) come from moments, (a - b)**2 being a sum of squares and products: one pass, no matrix.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    seen = F.avg((x - y) * (x - y))
    chance = F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(chance > 1e-12, 1 - seen / chance).alias("kappa"))


def confusion(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
