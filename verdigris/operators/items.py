"""Item psychometrics, bootstrap intervals, leaderboards and contamination probes over (model, task, id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.functions import text as X
from verdigris.functions.stats import pearson, same, spearman
from verdigris.operators.containment import occurrences
from verdigris.operators.resampling import bootstrap_means
from verdigris.operators.samples import first_by
from verdigris.schemas import HEADLINE

# The canon by how well it is known.
TIER3 = ("论语", "孟子", "大学", "中庸", "诗经", "周易", "尚书", "礼记", "左传", "老子", "庄子", "孙子兵法", "史记")
TIER2 = ("汉书", "后汉书", "三国志", "资治通鉴", "韩非子", "荀子", "战国策", "国语", "墨子", "孝经", "尔雅", "仪礼", "周礼", "吕氏春秋", "淮南子", "列子", "公羊传", "穀梁传", "晋书")


def item_stats(scores: DataFrame) -> DataFrame:
    """(task, id, n, difficulty, variance, discrimination) from (model, task, id, score).

    Discrimination correlates an item's score with the model's mean over the task's other items, by the
    model's sum less the item, where a loop would read every item for every item. Sums are combined before they are shuffled.
    """
    known = scores.filter("score IS NOT NULL")
    sums = known.groupBy("task", "model").agg(F.sum("score").alias("_sum"), F.count("score").alias("_count"))
    rest = (F.col("_sum") - F.col("score")) / F.nullif(F.col("_count") - 1, F.lit(0))
    with_rest = same(known, sums, ["task", "model"]).withColumn("rest", rest)
    return with_rest.groupBy("task", "id").agg(F.count("score").alias("n"), F.round(F.avg("score"), 4).alias("difficulty"), F.round(F.var_pop("score"), 6).alias("variance"), F.round(pearson("score", "rest"), 4).alias("discrimination"))


MOMENTS = ("n", "s", "ss", "r", "rr", "sr")


def item_moments(scores: DataFrame) -> DataFrame:
    """(task, id, n, s, ss, r, rr, sr) from (model, task, id, score): sums over models of an item's score s, of the model's mean r over
    the task's other items, and of their squares and products. An item that is alone in its task has no r. A model's part depends on its own
    rows only, so states of different models add up; a whole model and task belong into one state."""
    known = scores.filter("score IS NOT NULL").select("model", "task", "id", F.col("score").cast("double").alias("_s"))
    sums = known.groupBy("task", "model").agg(F.sum("_s").alias("_sum"), F.count("_s").alias("_count"))
    rest = (F.col("_sum") - F.col("_s")) / F.nullif(F.col("_count") - 1, F.lit(0))
    each = same(known, sums, ["task", "model"]).withColumn("_r", rest)
    total = lambda c, name: F.sum(c).alias(name)
    s, r = F.col("_s"), F.col("_r")
    return each.groupBy("task", "id").agg(F.count(F.lit(1)).alias("n"), total(s, "s"), total(s * s, "ss"), total(r, "r"), total(r * r, "rr"), total(s * r, "sr"))


def merged_moments(state: DataFrame, more: DataFrame, sign: int = 1) -> DataFrame:
    """A state with further models' moments, or (sign -1) without those of models whose results are withdrawn: the cost is that of the
    items, whatever number of models they stand for. Items that no model is left for go."""
    signed = more.select("task", "id", *[(sign * F.col(c)).alias(c) for c in MOMENTS])
    both = state.select("task", "id", *MOMENTS).unionByName(signed).groupBy("task", "id").agg(*[F.sum(c).alias(c) for c in MOMENTS])
    return both.filter("n > 0")


def moment_stats(state: DataFrame) -> DataFrame:
    """``item_stats`` of a state."""
    n = F.col("n")
    spread = lambda x, xx: F.greatest(F.col(xx) / n - F.col(x) / n * (F.col(x) / n), F.lit(0.0))
    noise = lambda x: F.lit(1e-12) * F.greatest(F.col(x) / n, F.lit(1.0))  # noqa: E731  what is left of equal numbers
    vs, vr = spread("s", "ss"), spread("r", "rr")
    together = F.col("sr") / n - F.col("s") / n * (F.col("r") / n)
    told = (n >= 3) & (vs > noise("ss")) & (vr > noise("rr"))
    return state.select("task", "id", "n", F.round(F.col("s") / n, 4).alias("difficulty"), F.round(vs, 6).alias("variance"), F.when(told, F.round(together / F.sqrt(vs * vr), 4)).alias("discrimination"))


def headline_scores(rows: DataFrame, headline: dict[str, str] = HEADLINE) -> DataFrame:
    """(model, task, id, score): each item's score by its task's headline metric, from a scores map; items without it are left out."""
    metric = F.create_map(*[F.lit(x) for pair in headline.items() for x in pair])[F.col("task")]
    return rows.select("model", "task", "id", F.try_element_at("scores", metric).cast("double").alias("score")).filter("score IS NOT NULL")


def rewrites(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, rewritten): punctuated items whose text was changed."""
    kept = F.try_element_at("scores", F.lit("char_preserved"))
    return rows.filter(kept.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(kept == 0).alias("rewritten"))


def recall_class(rho: Column) -> Column:
    """What a rank correlation of canonicity and difficulty says of a task."""
    return F.when(rho >= 0.30, "recall-driven").when(F.abs(rho) < 0.15, "clean").when(rho.isNotNull(), "mixed")


def dead(variance: Column) -> Column:
    return variance < 1e-4


def task_profile(stats: DataFrame, by: list[str]) -> DataFrame:
    """Counts of dead, ceiling, floor, negative and weakly telling items; from rounded values, a null discrimination counts as 0 for neither sign."""
    flat = dead(F.col("variance"))
    return stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.round(F.avg("difficulty"), 4).alias("difficulty_mean"),
        F.round(F.avg("discrimination"), 4).alias("discrimination_mean"),
        F.count_if(flat).alias("dead"),
        F.count_if(flat & (F.col("difficulty") >= 0.95)).alias("ceiling"),
        F.count_if(flat & (F.col("difficulty") <= 0.05)).alias("floor"),
        F.count_if(F.coalesce("discrimination", F.lit(0.0)) < 0).alias("negative_disc"),
        F.count_if(F.abs("discrimination") < 0.10).alias("low_disc"),
    )


def worst_negative(stats: DataFrame, n: int = 8) -> DataFrame:
    return first_by(stats.filter("discrimination < 0"), ["task"], [F.col("discrimination"), F.col("id")], n)


def _task_rho(means: DataFrame, least: int) -> DataFrame:
    a, b = means.alias("a"), means.alias("b")
    pairs = a.join(b, F.col("a.model") == F.col("b.model")).filter(F.col("a.task") < F.col("b.task"))
    pairs = pairs.select(F.col("a.task").alias("task_a"), F.col("b.task").alias("task_b"), F.col("a.mean").alias("x"), F.col("b.mean").alias("y"))
    return spearman(pairs, "x", "y", ["task_a", "task_b"], least)


def task_redundancy(means: DataFrame, least: int = 3) -> DataFrame:
    """(task_a, task_b, n, rho) for pairs of tasks, from (model, task, mean): Spearman over the models of both."""
    return _task_rho(means, least).withColumn("rho", F.round("rho", 4))


def redundancy_matrix(means: DataFrame, least: int = 3, flagged: float = 0.8) -> DataFrame:
    """(task_a, task_b, n, rho, redundant) for every pair of tasks that ``least`` models have, a task with itself too, from (model, task, mean).
    Correlations are rounded once, to three places."""
    present = means.groupBy("task").agg(F.count("mean").alias("n")).filter(F.col("n") >= least)
    known = means.join(present.select("task"), "task", "left_semi")
    pairs = _task_rho(known, least).withColumn("rho", F.round("rho", 3))
    alone = present.select(F.col("task").alias("task_a"), F.col("task").alias("task_b"), "n", F.lit(1.0).alias("rho"))
    both = pairs.unionByName(alone)
    return both.withColumn("redundant", F.coalesce((F.col("task_a") != F.col("task_b")) & (F.abs("rho") >= flagged), F.lit(False)))


def bounds(means: DataFrame, by: list[str], iterations: int, alpha: float = 0.05) -> DataFrame:
    """(by..., ci_lo, ci_hi, half_width): order statistics of the resampled means, not interpolated."""
    sorted_means = F.sort_array(F.collect_list("m"))
    lo, hi = int(alpha / 2 * iterations), int((1 - alpha / 2) * iterations) - 1
    out = means.groupBy(*by).agg(F.get(sorted_means, F.lit(lo)).alias("_lo"), F.get(sorted_means, F.lit(hi)).alias("_hi"))
    return out.select(*by, F.round("_lo", 4).alias("ci_lo"), F.round("_hi", 4).alias("ci_hi"), F.round((F.col("_hi") - F.col("_lo")) / 2, 4).alias("half_width"))


def bootstrap_ci(scores: DataFrame, by: list[str], order: str = "id", iterations: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    point = scores.filter("score IS NOT NULL").groupBy(*by).agg(F.count("score").alias("n"), F.round(F.avg("score"), 4).alias("mean"))
    return point.join(bounds(bootstrap_means(scores, by, order, iterations, seed), by, iterations, alpha), by)


def bootstrap_average(scores: DataFrame, model: str = "model", task: str = "task", order: str = "id", iterations: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The same for the mean of a model's task means, whose tasks are resampled each on its own."""
    joint = bootstrap_means(scores, [model, task], order, iterations, seed).groupBy(model, "b").agg(F.avg("m").alias("m"))
    means = scores.filter("score IS NOT NULL").groupBy(model, task).agg(F.avg("score").alias("m")).groupBy(model).agg(F.round(F.avg("m"), 4).alias("mean"), F.count(F.lit(1)).alias("n_tasks"))
    return means.join(bounds(joint, [model], iterations, alpha), model)


def leaderboard(means: DataFrame, intervals: DataFrame | None = None, ties: str = "model") -> DataFrame:
    """(model, task, mean, half_width, avg, place): models by the mean over the tasks that they have; equal ones by the
    column ``ties``, such as the file that a model's document was read from."""
    average = means.groupBy("model").agg(F.round(F.avg("mean"), 4).alias("avg"), F.min(ties).alias("_tie"))
    ranked = average.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("avg", F.lit(0.0)).desc(), "_tie"))).drop("_tie")
    out = means.join(ranked, "model")
    if intervals is None:
        return out.withColumn("half_width", F.lit(None).cast("double"))
    return out.join(intervals.select("model", "task", "half_width"), ["model", "task"], "left")


def judged_board(judged: DataFrame, complete: int = 90) -> DataFrame:
    """(model, task, judge_mean, n, partial, judge_avg): means of normalised judge scores; the average is over tasks of ``complete`` items at least, -1 without any."""
    means = judged.groupBy("model", "task").agg(F.round(F.avg("score"), 4).alias("judge_mean"), F.count("score").alias("n"))
    w = Window.partitionBy("model")
    return means.withColumns({"partial": F.col("n") < complete, "judge_avg": F.coalesce(F.round(F.avg(F.when(F.col("n") >= complete, F.col("judge_mean"))).over(w), 4), F.lit(-1.0))})


def tiers(source: Column, top: tuple[str, ...] = TIER3, second: tuple[str, ...] = TIER2) -> Column:
    book = X.source_head(source)
    return F.when(book == "", None).when(book.isin(*top), 3).when(book.isin(*second), 2).otherwise(1)


def tier_difficulty(rows: DataFrame, by: list[str], tier: str = "tier", difficulty: str = "difficulty") -> DataFrame:
    """(by..., tier, n, mean_difficulty) with all three tiers for every group, empty ones null."""
    spark = rows.sparkSession
    seen = rows.filter(F.col(tier).isNotNull()).groupBy(*by, F.col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(difficulty), 4).alias("mean_difficulty"))
    grid = spark.createDataFrame([(1,), (2,), (3,)], "tier int")
    grid = rows.select(*by).distinct().crossJoin(F.broadcast(grid)) if by else grid  # three rows
    out = grid.join(seen, [*by, "tier"], "left")
    return out.select(*by, "tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_difficulty")


def contamination(rows: DataFrame, by: list[str], hits: str = "hits", tier: str = "tier", difficulty: str = "difficulty") -> DataFrame:
    """(by..., n, rho_canonicity, rho_shingle): rank correlations of difficulty with the tier and with log1p of corpus hits; null below four items."""
    keys = by or ["_all"]
    keyed = rows if by else rows.withColumn("_all", F.lit(1))
    known = keyed.filter(F.col(tier).isNotNull())
    a = spearman(known, tier, difficulty, keys, least=4, name="rho_canonicity")
    b = spearman(known.withColumn("_log", F.log1p(hits)), "_log", difficulty, keys, least=4, name="rho_shingle").drop("n")
    return a.join(b, keys, "left").drop("_all")


def shingle_hits(items: DataFrame, corpus: DataFrame, key: str, shingle: str, text: str) -> DataFrame:
    """(key, hits): occurrences, not overlapping, of each item's shingle in all corpus texts; 0 for an empty one."""
    found = occurrences(corpus, items, shingle, text).groupBy("part").agg(F.sum("hits").alias("hits"))
    return items.join(found, F.col(shingle) == F.col("part"), "left").select(key, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def containing(items: DataFrame, corpus: DataFrame, key: str, shingle: str, text: str) -> DataFrame:
    """(key, n_items): texts that hold an item's shingle, with the number of items."""
    found = occurrences(corpus, items, shingle, text, [key])
    counts = items.groupBy(F.col(shingle).alias("part")).agg(F.count(F.lit(1)).alias("_n"))
    return found.join(counts, "part").groupBy(key).agg(F.sum("_n").alias("n_items"))


def item_shingles(records: DataFrame, size: int, quoted: str = "idiom-source") -> DataFrame:
    """(id, task, source, shingle): what a corpus is searched for, the middle of the reference without marks or, of ``quoted`` items, of the expected quote as it is."""
    of = lambda key: F.nullif(F.col("metadata")[key], F.lit(""))
    part = F.when(F.col("task") == quoted, X.middle(F.coalesce(F.col("metadata")["expected_quote"], F.lit("")), size)).otherwise(X.shingle(F.coalesce("reference", F.lit("")), size))
    return records.select("id", "task", F.coalesce(of("source"), of("book")).alias("source"), part.alias("shingle"))


def probe(records: DataFrame, difficulty: DataFrame, corpus: DataFrame, text: str, size: int = 10, left_out: tuple[str, ...] = ("char-gloss",), top: tuple[str, ...] = TIER3, second: tuple[str, ...] = TIER2) -> DataFrame:
    """The contamination probe from records (id, task, reference, metadata), difficulties (task, id, difficulty) and a corpus of texts.

    (task, n, rho_canonicity, rho_shingle, mean_1, n_1, mean_2, n_2, mean_3, n_3, gap, class): rank correlations of an item's
    difficulty with its source's tier and with the corpus hits of its shingle, difficulty by tier, how much easier the top tier is, and
    what the first correlation says; for each task and, with a null task, for all items together. Items
    without a source and tasks in ``left_out`` take no part; items without a shingle only lack the second correlation.
    """
    marked = item_shingles(records.filter(~F.col("task").isin(*left_out)), size).withColumn("tier", tiers(F.col("source"), top, second)).filter("tier IS NOT NULL")
    hits = shingle_hits(marked.select("task", "id", "shingle").withColumn("_key", F.struct("task", "id")), corpus, "_key", "shingle", text).select("_key.task", "_key.id", "hits")
    rows = marked.join(hits, ["task", "id"]).join(difficulty.select("task", "id", "difficulty"), ["task", "id"]).withColumn("hits", F.when(F.col("shingle") != "", F.col("hits")))
    each = rows.withColumn("_all", F.lit(False)).unionByName(rows.withColumn("_all", F.lit(True)).withColumn("task", F.lit(None).cast("string")))
    group = F.coalesce("task", F.lit("")).alias("_task")  # ids of tasks aren't empty
    keyed = each.select("*", group)
    rho = contamination(keyed, ["_task"])
    by_tier = keyed.groupBy("_task").agg(*[c for k in (1, 2, 3) for c in (F.round(F.avg(F.when(F.col("tier") == k, F.col("difficulty"))), 4).alias(f"mean_{k}"), F.count_if(F.col("tier") == k).alias(f"n_{k}"))])
    out = rho.join(by_tier, "_task").withColumns({"gap": F.round(F.col("mean_3") - F.col("mean_1"), 4), "class": recall_class(F.col("rho_canonicity"))})
    return out.select(F.nullif("_task", F.lit("")).alias("task"), "n", "rho_canonicity", "rho_shingle", *[f"{c}_{k}" for k in (1, 2, 3) for c in ("mean", "n")], "gap", "class")
