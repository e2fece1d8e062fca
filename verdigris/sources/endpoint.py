"""A chat model as a source: an injected client answers prompts on the executors, with retries and bounded concurrency."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Client = Callable[[str], dict]


@dataclass
class Settings:
    concurrency: int = 4
    retries: int = 3
    wait: float = 1.5  # seconds before try k + 1: k times this


def headers(lines: list[str]) -> dict[str, str]:
    """Extra headers from "Name: value" texts; those without a colon are left out."""
    parts = (line.partition(":") for line in lines)
    return {name.strip(): value.strip() for name, colon, value in parts if colon}


def stub(prompt: str) -> dict:
    """A deterministic client for tests: answers with the prompt's last line."""
    return {"content": prompt.splitlines()[-1] if prompt else "", "prompt_tokens": len(prompt), "completion_tokens": len(prompt.splitlines()[-1]) if prompt else 0}


def predictions(df: DataFrame, make_client: Callable[[], Client], prompt_col: str = "prompt", settings: Settings = Settings(), accept: Callable[..., bool] | None = None, context: str | None = None) -> DataFrame:  # noqa: B008
    """Adds prediction ("" after the last failure, as a missing content), error, prompt_tokens, completion_tokens, asked_at (Unix time) and latency_s.

    ``make_client`` runs once in each task and takes its endpoint and key from the executor's environment. Rows keep their keys, so the order of answers plays no part.
    ``accept``: a reply that it refuses is asked for again like a failed call; the last one stays, with an error. ``context``: a column whose value it gets too.
    """
    added = T.StructType([T.StructField("prediction", T.StringType()), T.StructField("error", T.StringType()), T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()), T.StructField("asked_at", T.DoubleType()), T.StructField("latency_s", T.DoubleType())])
    names = [f.name for f in added]
    base = df.drop(*names)

    def ask(client: Client, prompt: str, *more: str) -> tuple:
        asked, began, error, last = time.time(), time.monotonic(), None, ""
        for k in range(settings.retries):
            try:
                found = client(prompt)
                reply = found.get("content") or ""
                if accept is None or accept(reply, *more):
                    return reply, None, found.get("prompt_tokens"), found.get("completion_tokens"), asked, time.monotonic() - began
                last, error = reply, "reply refused"
            except Exception as e:  # noqa: BLE001  any failure counts as an unanswered prompt
                error = f"{type(e).__name__}: {e}"
                if k + 1 < settings.retries:
                    time.sleep(settings.wait * (k + 1))
        return last, error, None, None, asked, time.monotonic() - began

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        with ThreadPoolExecutor(settings.concurrency) as pool:
            for batch in batches:
                told = [batch[context].fillna("")] if context is not None else []
                answers = list(pool.map(lambda p, *more: ask(client, p or "", *more), batch[prompt_col], *told))
                extra = pd.DataFrame(answers, columns=names, index=batch.index).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})
                yield pd.concat([batch, extra], axis=1)

    return base.mapInPandas(run, T.StructType([*base.schema.fields, *added.fields]))
