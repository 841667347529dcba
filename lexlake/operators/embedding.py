"""Embedding texts with a function of one's own, in batches bounded by texts and tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TEXTS, TOKEN_BUDGET = 128, 110_000


def token_batches(texts: list[str], count: Callable[[str], int] = lambda t: len(t) // 2, most: int = MOST_TEXTS, budget: int = TOKEN_BUDGET) -> Iterator[list[str]]:
    """In order, as many together as both bounds allow; a text above the budget goes alone."""
    held, used = [], 0
    for t in texts:
        n = count(t)
        if held and (len(held) >= most or used + n > budget):
            yield held
            held, used = [], 0
        held.append(t)
        used += n
    if held:
        yield held


def hashed_embedding(texts: list[str], width: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed counts of hashed words, of length 1."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            row[h % width] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """Vectors of documents and of queries, which some models make in different ways."""

    name: str
    width: int
    documents: Callable[[list[str]], np.ndarray]
    queries: Callable[[list[str]], np.ndarray]


MODELS: dict[str, Callable[[], Model]] = {"hashed-64": lambda: Model("hashed-64", 64, hashed_embedding, hashed_embedding)}


def model_named(name: str) -> Model:
    """A model by the name under which MODELS has it; unknown names raise."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name]()


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], np.ndarray] = hashed_embedding, out: str = "embedding") -> DataFrame:
    """Adds the model's vector of each text; null counts as empty."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            done = [v for batch in token_batches(texts.fillna("").tolist()) for v in model(batch)]
            yield pd.Series([v.tolist() for v in done])

    return df.withColumn(out, run(F.col(text_col)))
