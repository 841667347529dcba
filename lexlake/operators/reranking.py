"""Scores of (query, text) pairs by a model of one's own, in batches bounded by tokens, whatever queries they belong to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import rerank

#: Pairs of a batch, and tokens that it takes once all its pairs are as long as its longest.
MOST_PAIRS, TOKEN_BUDGET = 64, 16_384

Scorer = Callable[[list[tuple[str, str]]], "np.ndarray | list[float]"]


def pair_batches(lengths: np.ndarray, most: int = MOST_PAIRS, budget: int = TOKEN_BUDGET) -> Iterator[np.ndarray]:
    """Numbers of the pairs, the shortest first, as many together as both bounds allow; a pair above the budget goes alone."""
    order = np.argsort(lengths, kind="stable")
    begin = 0
    for k in range(1, len(order) + 1):
        if k == len(order) or k - begin >= most or (k - begin + 1) * lengths[order[k]] > budget:
            yield order[begin:k]
            begin = k


def pair_scores(query: Column, text: Column, scorer: Scorer, count: Callable[[str], int] = lambda t: len(t) // 2, most: int = MOST_PAIRS, budget: int = TOKEN_BUDGET) -> Column:
    """The scorer's number for each pair. It sees pairs of about one length, of many queries, and the scores go back to the rows they belong to; null
    counts as empty. The model is loaded when the function is first called in a worker, if `scorer` does it then."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in parts:
            pairs = list(zip(queries.fillna("").tolist(), texts.fillna("").tolist(), strict=True))
            out = np.zeros(len(pairs))
            for some in pair_batches(np.array([count(q) + count(t) for q, t in pairs], np.int64), most, budget):
                out[some] = scorer([pairs[k] for k in some.tolist()])
            yield pd.Series(out)

    return run(query, text)


def rerank_pairs(hits: DataFrame, query: str, text: str, scorer: Scorer, k: int, **bounds: int) -> DataFrame:
    """hits (query_id, id, rank and the two texts) by the scorer's numbers, equal ones in the order they had, best k of each query."""
    return rerank(hits, pair_scores(F.col(query), F.col(text), scorer, **bounds), k)
