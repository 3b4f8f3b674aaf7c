"""Reranking by an injected model and encoding by an injected model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score_column(load: Callable[[], Callable[[list[str]], list[float]]]):
    """A scorer of prompts as a pandas UDF; ``load`` builds the model once to a worker."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            yield pd.Series(model(prompts.tolist()), dtype="float64")

    return score


def encode_column(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """An encoder of texts as a pandas UDF."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.tolist()))

    return encode


def rerank(candidates: DataFrame, load, prompt: str = "prompt", top_k: int = 20) -> DataFrame:
    """(query_id, skill_id, reranker_score, reranker_rank) of each query's first ``top_k`` candidates."""
    scored = candidates.where(F.col("rank") <= top_k).withColumn("reranker_score", score_column(load)(prompt))
    order = Window.partitionBy("query_id").orderBy(F.desc("reranker_score"), "skill_id")
    return scored.select("query_id", "skill_id", "reranker_score", F.row_number().over(order).alias("reranker_rank"))
