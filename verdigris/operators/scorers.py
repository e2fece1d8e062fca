"""Scorers by task: a registry of functions from columns to a map of metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.functions import textmetrics as M

Metrics = dict[str, Column]


class Metadata(dict):
    """Columns of metadata keys; those that aren't prepared come from the map."""

    def __missing__(self, key: str) -> Column:
        return F.col("metadata")[key]


#: From two texts to a struct of chrf and char_f1.
Pair = Callable[[Column, Column], Column]
Scorer = Callable[[Column, Column, Column, Metadata, Pair], Metrics]


class Scorers:
    """``table``: one-to-one characters for traditional script; ``compose``: False skips NFKC, which needs Python.

    A scorer takes texts that ``score`` has composed and stripped, those of tasks in ``raw`` as they are, and asks for the scores of at most one pair.
    """

    def __init__(self, table: dict[str, str] | None = None, aliases: dict[str, list[str]] = X.BOOK_ALIASES, compose: bool = True, letters: str = X.HAN, pair: Pair = M.pair_scores):
        self.table, self.aliases, self.compose, self.letters, self.pair = table, aliases, compose, letters, pair
        self.registry: dict[str, Scorer] = {"translate": self.translate, "punctuate": self.punctuate, "char-gloss": self.gloss, "idiom-source": self.source, "fill-in": self.cloze, "compress": self.compress}
        self.raw = {"compress"}

    def translate(self, p: Column, r: Column, given: Column, metadata: Metadata, pair: Pair) -> Metrics:
        found = pair(p, r)
        return {"chrf": found["chrf"], "char_f1": found["char_f1"]}

    def punctuate(self, p: Column, r: Column, given: Column, metadata: Metadata, pair: Pair) -> Metrics:
        """chrf is null where neither text has a mark."""
        bare_p, bare_r = X.without(p, X.PUNCTUATION), X.without(r, X.PUNCTUATION)
        marked = (p != bare_p) | (r != bare_r)
        return {"punct_f1": M.mark_f1(p, r), "char_preserved": (bare_p == bare_r).cast("double"), "chrf": F.when(marked, pair(p, r)["chrf"])}

    def gloss(self, p: Column, r: Column, given: Column, metadata: Metadata, pair: Pair) -> Metrics:
        p, r = X.without(p, X.PUNCTUATION), X.without(r, X.PUNCTUATION)
        found = pair(p, r)
        return {"chrf": found["chrf"], "char_f1": found["char_f1"]}

    def source(self, p: Column, r: Column, given: Column, metadata: Metadata, pair: Pair) -> Metrics:
        return {"book_em": X.book_hit(p, F.coalesce(metadata["book"], F.lit("")), self.aliases, self.table).cast("double"), "quote_chrf": pair(p, metadata["expected_quote"])["chrf"]}

    def cloze(self, p: Column, answer: Column, given: Column, metadata: Metadata, pair: Pair) -> Metrics:
        found, wanted = X.convert(X.quoted_or_first(p, self.letters), self.table), X.convert(answer, self.table)
        return {"exact_match": ((found == wanted) & (found != "")).cast("double"), "in_pred": (p.contains(answer) | X.convert(p, self.table).contains(wanted)).cast("double")}

    def compress(self, prediction: Column, reference: Column, given: Column, metadata: Metadata, pair: Pair) -> Metrics:
        """Texts as they are; each metric rounded to 4 places, efficiency from unrounded ones."""
        p, r, source = (F.coalesce(c, F.lit("")) for c in (prediction, reference, given))
        fidelity = pair(p, r)["chrf"]
        ratio = F.char_length(X.only(p, self.letters)) / F.greatest(F.char_length(X.only(source, self.letters)), F.lit(1))
        shorter = F.greatest(F.lit(0.0), 1 - ratio)
        return {"chrf": F.round(fidelity, 4), "ratio": F.round(ratio, 4), "compression": F.round(shorter, 4), "efficiency": F.round(fidelity * shorter, 4)}

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` (task, input, reference, prediction, metadata map, ...) with ``scores``, a map of metrics; null for unknown tasks.

        All tasks in one pass: texts are composed and stripped once a row, and each row's two texts to be compared
        go to Python in one column each. Metrics stand in branches, so only those of a row's task are computed for it.
        """
        task = F.col("task")
        raw = F.coalesce(task.isin(*self.raw), F.lit(False))

        def prepared(c: Column) -> Column:
            composed = X.nfkc(F.when(~raw, F.coalesce(c, F.lit("")))) if self.compose else c
            return F.when(raw, c).otherwise(X.squeeze(composed))

        asked: dict[str, tuple[Column, Column]] = {}

        def ask(name: str) -> Pair:
            return lambda p, r: asked.update({name: (p, r)}) or F.col("_pair")

        rows = df.withColumns({"_p": prepared(F.col("prediction")), "_r": prepared(F.col("reference")), "_q": prepared(F.col("metadata")["expected_quote"])})
        metrics = {t: scorer(F.col("_p"), F.col("_r"), F.col("input"), Metadata(expected_quote=F.col("_q")), ask(t)) for t, scorer in self.registry.items()}
        texts = [F.coalesce(*[F.when(task == t, sides[k]) for t, sides in asked.items()]) if asked else F.lit(None).cast("string") for k in (0, 1)]
        rows = rows.withColumns({"_a": texts[0], "_b": texts[1]}).withColumn("_pair", self.pair(F.col("_a"), F.col("_b")))
        maps = [F.when(task == t, F.map_filter(F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*[v.cast("double") for v in m.values()])), lambda _, v: v.isNotNull())) for t, m in metrics.items()]
        return rows.withColumn("scores", F.coalesce(*maps)).drop("_p", "_r", "_q", "_a", "_b", "_pair")


def summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, mean, n) of a scores map; every metric has its own number of items."""
    each = scored.select(*by, F.explode("scores").alias("metric", "score"))
    return each.groupBy(*by, "metric").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("score").alias("n"))


def rescored(items: DataFrame, records: DataFrame, scorers: Scorers, kept: tuple[str, ...] = ("judge", "judge_norm", "judge_sonnet", "judge_sonnet_norm")) -> DataFrame:
    """Items (model, task, id, prediction, scores) scored again by their records; judge scores stay."""
    joined = items.alias("i").join(records.select("id", "input", "reference", "metadata").alias("r"), "id")
    again = scorers.score(joined.select("model", "task", "id", "prediction", "input", "reference", "metadata", F.col("scores").alias("_old")))
    judges = F.map_filter("_old", lambda k, _: k.isin(*kept))
    return again.withColumn("scores", F.map_from_entries(F.array_union(F.map_entries(F.map_filter("scores", lambda k, _: ~k.isin(*kept))), F.map_entries(judges)))).drop("_old")


def summary_changes(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, old, new) of means that differ, metrics of one side too."""
    keys = [*by, "metric"]
    joined = old.select(*keys, F.col("mean").alias("old")).join(new.select(*keys, F.col("mean").alias("new")), keys, "full_outer")
    return joined.filter(~F.col("old").eqNullSafe(F.col("new")))


def rescored_documents(items: DataFrame, records: DataFrame, scorers: Scorers, old: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items scored again, their new summary (model, task, metric, mean) and its changes against ``old``, of the same columns.

    Items without a record keep their scores and don't count. Metrics whose name ends in _n count items and
    aren't scores: they are taken over from the old summary.
    """
    known = rescored(items, records, scorers)
    others = items.join(records.select("id").distinct(), "id", "left_anti")
    means = summary(known, ["model", "task"]).select("model", "task", "metric", "mean")
    keys = ["model", "task", "metric"]
    carried = old.select(*keys, "mean").filter(F.col("metric").endswith("_n")).join(means.select("model", "task").distinct(), ["model", "task"], "left_semi").join(means, keys, "left_anti")
    new = means.unionByName(carried)
    return known.select(items.columns).unionByName(others.select(items.columns)), new, summary_changes(old, new, ["model", "task"])
