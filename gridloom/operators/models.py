"""Places where models plug in: encoders of texts and selectors that answer prompts. Models themselves are given."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import strip

ANSWER = "answer string, status string, error string, attempts int, prompt_tokens long, output_tokens long, cached_tokens long, latency_seconds double"


def encoded(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], keep: list[str]) -> DataFrame:
    """keep and vector (unit length) of each text; null texts have no vector. `load` runs once per task and returns a
    function from texts to a matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for pdf in batches:
            there = pdf[text].notna().to_numpy()
            vectors = np.asarray(encode(pdf.loc[there, text].tolist()), np.float64) if there.any() else np.empty((0, 0))
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            rows = iter(vectors)
            yield pdf[keep].assign(vector=[next(rows).astype(np.float32).tolist() if t else None for t in there])

    kinds = dict(df.dtypes)
    return df.select(*dict.fromkeys([*keep, text])).mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "vector array<float>"]))


def answered(df: DataFrame, prompt: str, load: Callable[[], Callable[[str, int], dict]], keep: list[str], attempts: int = 3, delay: float = 0.0) -> DataFrame:
    """keep and the columns of ANSWER for each prompt. `load` runs once per task and returns a function from a prompt
    and the attempt's number to a dict with `answer` and, if known, token counts. An attempt that raises is tried
    again after delay * 2 ** (attempt - 1) seconds; the last error stays in the row, with status `failed`."""

    def one(ask: Callable[[str, int], dict], text: str) -> tuple:
        began, error, usage = time.monotonic(), None, {}
        for attempt in range(1, attempts + 1):
            try:
                usage = ask(text, attempt)
                return usage["answer"], "succeeded", None, attempt, *(int(usage.get(c) or 0) for c in ("prompt_tokens", "output_tokens", "cached_tokens")), time.monotonic() - began
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
                if attempt < attempts and delay:
                    time.sleep(delay * 2 ** (attempt - 1))
        return None, "failed", error, attempts, 0, 0, 0, time.monotonic() - began

    names = [c.split()[0] for c in ANSWER.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for pdf in batches:
            rows = pd.DataFrame([one(ask, p) for p in pdf[prompt]], columns=names, index=pdf.index)
            yield pd.concat([pdf[keep], rows], axis=1)

    kinds = dict(df.dtypes)
    return df.select(*dict.fromkeys([*keep, prompt])).mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), ANSWER]))


def request_errors(requests: DataFrame, query: str = "query", urls: str = "urls") -> DataFrame:
    """requests with errors: a blank query, no addresses, and addresses that aren't https."""
    blank = F.coalesce(strip(F.col(query)), F.lit("")) == ""
    wrong: Column = F.transform(F.filter(urls, lambda u: ~F.coalesce(u.rlike(r"(?i)^https://[^/\s]+"), F.lit(False))), lambda u: F.concat(F.lit("no https address: "), F.coalesce(u, F.lit("null"))))
    found = F.concat(F.array(F.when(blank, "blank query"), F.when(F.coalesce(F.size(urls), F.lit(0)) <= 0, "no addresses")), F.coalesce(wrong, F.array().cast("array<string>")))
    return requests.withColumn("errors", F.array_compact(found))
