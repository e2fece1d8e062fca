"""Markdown reports of small frames: ordered, collected and formatted on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.schemas import HEADLINE


def number(value: float | None, places: int = 3, half: float | None = None, mark: str = "") -> str:
    if value is None:
        return "—"
    return f"{value:.{places}f}" + (f" ±{half:.{places}f}" if half is not None else "") + mark


def table(rows: list[list[str]], heads: list[str]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [heads, ["---"] * len(heads), *rows])


def markdown(df: DataFrame, heads: dict[str, str], show: dict[str, Callable] | None = None) -> str:
    """A table of a small ordered frame; ``heads``: column and title."""
    show = show or {}
    rows = [[show.get(c, lambda v: "—" if v is None else str(v))(r[c]) for c in heads] for r in df.select(*heads).collect()]
    return table(rows, list(heads.values()))


def leaderboard_report(board: DataFrame, tasks: dict[str, str] = HEADLINE) -> str:
    """From (model, task, mean, half_width, avg, place): a row for each model, a column for each task."""
    wide = board.groupBy("place", "model", "avg").pivot("task", list(tasks)).agg(F.first("mean").alias("m"), F.first("half_width").alias("h")).orderBy("place")
    rows = [[r["model"], *(number(r[f"{t}_m"], 3, r[f"{t}_h"]) for t in tasks), number(r["avg"])] for r in wide.collect()]
    return table(rows, ["model", *(f"{t} ({m})" for t, m in tasks.items()), "avg"])


def judged_report(board: DataFrame) -> str:
    rows = [[r["model"], r["task"], number(r["judge_mean"], 3, None, "*" if r["partial"] else "")] for r in board.orderBy(F.col("judge_avg").desc(), "model", "task").collect()]
    return table(rows, ["model", "task", "judge"])


def item_report(profile: DataFrame, worst: DataFrame, redundancy: DataFrame) -> str:
    """Psychometrics: a row for each task of ``items.task_profile``, its worst items, and pairs of tasks that rank models alike."""
    counts = {"task": "task", "n_items": "items", "difficulty_mean": "difficulty", "discrimination_mean": "discrimination", "dead": "dead", "ceiling": "ceiling", "floor": "floor", "negative_disc": "negative", "low_disc": "weak"}
    parts = ["## Items", markdown(profile.orderBy("task"), counts, {"difficulty_mean": number, "discrimination_mean": number})]
    parts += ["## Negative discrimination", markdown(worst.orderBy("task", "discrimination", "id"), {"task": "task", "id": "item", "discrimination": "discrimination"}, {"discrimination": number})]
    alike = redundancy.filter("redundant").orderBy(F.abs("rho").desc(), "task_a", "task_b")
    return "\n\n".join([*parts, "## Tasks that rank models alike", markdown(alike, {"task_a": "task", "task_b": "other", "rho": "rho"}, {"rho": number})])


def contamination_report(found: DataFrame) -> str:
    """From ``items.probe``: a row for each task, the one of all items last."""
    heads = {"task": "task", "n": "items", "rho_canonicity": "rho tier", "rho_shingle": "rho corpus", **{f"mean_{k}": f"tier {k}" for k in (3, 2, 1)}, "gap": "tier 3 less 1", "class": "class"}
    show = {c: number for c in heads if c.startswith(("rho", "mean")) or c == "gap"} | {"task": lambda v: v or "all"}
    return "## Contamination\n\n" + markdown(found.orderBy(F.col("task").asc_nulls_last()), heads, show)


def tokenizer_report(density: DataFrame, ranks: DataFrame) -> str:
    """From ``tokens.density`` by tokenizer and ``tokens.ranked``: means, characters a token, and the order."""
    dense = markdown(density.orderBy("tokenizer"), {"tokenizer": "tokenizer", "n": "texts", "tokens_mean": "tokens", "chars_per_token": "characters a token"}, {"tokens_mean": lambda v: number(v, 1), "chars_per_token": lambda v: number(v, 2)})
    value = next(c for c in ranks.columns if c not in ("tokenizer", "place", "best", "worst"))
    return "## Tokenizers\n\n" + dense + "\n\n" + markdown(ranks.orderBy("place"), {"place": "place", "tokenizer": "tokenizer", value: "ratio"}, {value: number})


def compression_report(accuracy: DataFrame, deltas: DataFrame) -> str:
    """From ``abtests.version_accuracy`` and ``version_deltas``."""
    rows = markdown(accuracy.orderBy("model", "version"), {"model": "model", "version": "version", "n_ok": "answers", "accuracy": "accuracy", "prompt_chars": "prompt", "output_chars": "output"}, {"accuracy": number})
    return "## Prompt versions\n\n" + rows + "\n\n" + markdown(deltas.orderBy("version"), {"version": "version", "n_models": "models", "delta_pp": "points", "chars_saved_pct": "characters saved %"}, {"delta_pp": lambda v: number(v, 2), "chars_saved_pct": lambda v: number(v, 1)})


def ab_report(summary: DataFrame, savings: DataFrame, by: str) -> str:
    """From ``abtests.report`` and ``top_savings`` of one key."""
    rows = markdown(summary.orderBy(by), {by: by, "n": "pairs", "ratio_mean": "ratio", "ratio_median": "median", "saved_pct": "saved %", "wins": "wins", "ties": "ties", "losses": "losses", "not_loss": "not lost", "decision": "decision"}, {c: number for c in ("ratio_mean", "ratio_median", "saved_pct", "not_loss")})
    key = next(c for c in savings.columns if c not in (by, "ratio"))
    return "## Outcomes\n\n" + rows + "\n\n" + markdown(savings.orderBy(by, F.col("ratio").desc(), key), {by: by, key: "pair", "ratio": "ratio"}, {"ratio": number})


def console(df: DataFrame, rows: int = 20) -> str:
    """The first rows of an ordered frame in columns of even width."""
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in df.limit(rows).collect()]]
    width = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in cells)
