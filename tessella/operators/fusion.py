"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reciprocal_rank_fusion(rankings: list[DataFrame], top_k: int, rrf_k: int = 60, key: str = "skill_id") -> DataFrame:
    """(query_id, key, score, rank) of rankings with (query_id, key, rank).

    An item counts once in each ranking, at its first place; ties go by key.
    """
    if top_k <= 0 or rrf_k <= 0:
        raise ValueError("top_k and rrf_k must be positive")
    tagged = [r.select("query_id", key, "rank", F.lit(i).alias("source")) for i, r in enumerate(rankings)]
    both = tagged[0]
    for more in tagged[1:]:
        both = both.unionByName(more)
    firsts = both.groupBy("query_id", key, "source").agg(F.min("rank").alias("rank"))
    summed = firsts.groupBy("query_id", key).agg(F.round(F.sum(1 / (F.lit(float(rrf_k)) + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
