"""Model providers: the one function point that users extend.

A provider completes prompts and embeds texts. Only the deterministic stub is
shipped; others are registered by name and run in Arrow batches, with a
fallback column where they fail.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import vectors


class Provider(Protocol):
    name: str

    def complete(self, prompt: str, max_tokens: int) -> str: ...

    def embed(self, text: str) -> list[float]: ...


class Stub:
    """Answers that depend on nothing but the prompt."""

    name = "stub"

    def complete(self, prompt: str, max_tokens: int) -> str:
        return "stub " + hashlib.md5(prompt.encode()).hexdigest()[:8]

    def embed(self, text: str) -> list[float]:
        return vectors.stub_vector(text)


_PROVIDERS: dict[str, Callable[[], Provider]] = {"stub": Stub}


def register_provider(name: str, make: Callable[[], Provider]) -> None:
    """make is called in each task, so that clients needn't be serialized."""
    _PROVIDERS[name] = make


def provider(name: str) -> Callable[[], Provider]:
    if name not in _PROVIDERS:
        raise ValueError(f"no provider named {name!r}")
    return _PROVIDERS[name]


def with_completion(df: DataFrame, prompt: Column, fallback: Column, name: str = "stub", out: str = "completion", max_tokens: int = 256) -> DataFrame:
    """df with the provider's answers to prompt; fallback where it fails or the prompt is null."""
    make = provider(name)

    @F.pandas_udf("string")
    def answer(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()

        def one(p: str | None) -> str | None:
            try:
                return None if p is None else model.complete(p, max_tokens)
            except Exception:  # a provider that is down must not stop a job: the fallback stands in
                return None

        for batch in prompts:
            yield batch.map(one, na_action="ignore").astype(object)

    return df.withColumn(out, F.coalesce(answer(prompt), fallback))
