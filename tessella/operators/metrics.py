"""Ranking metrics and the evaluation of predictions against tasks.

Rankings are long frames (query_id, rank, skill_id); gold sets are long frames (query_id, skill_id). Every task gives one
row of metrics; strata are means over tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.fixed import GOLD_FIELDS

METRICS = ("ndcg_1", "ndcg_3", "ndcg_10", "hit_1", "precision_3", "mrr_10", "recall_10", "recall_20", "recall_50", "full_coverage_1", "full_coverage_3", "full_coverage_5", "full_coverage_10")


def gold_ids(fields: tuple[str, ...] = GOLD_FIELDS) -> Column:
    """The first gold field that is a list, even an empty one, without empty or repeated ids."""
    first = F.coalesce(*[F.col(f) for f in fields], F.array().cast("array<string>"))
    return F.array_distinct(F.filter(first, lambda x: x.isNotNull() & (x != "")))


def prediction_ids(*forms: Column) -> Column:
    """The first non-empty list of the forms that a prediction may take."""
    full = [F.when(F.size(f) > 0, f) for f in forms]
    return F.filter(F.coalesce(*full, F.array().cast("array<string>")), lambda x: x.isNotNull())


def query_key() -> Column:
    """task_id, or query_id where that is null or empty."""
    return F.coalesce(F.nullif(F.col("task_id"), F.lit("")), F.nullif(F.col("query_id"), F.lit("")))


def query_text() -> Column:
    return F.coalesce(F.nullif(F.col("query"), F.lit("")), F.col("task"))


def ranked_in_pool(rankings: DataFrame, pool: DataFrame) -> DataFrame:
    """Rankings less what isn't in the pool and what came before, ranked anew from 1."""
    firsts = rankings.join(pool.select("skill_id").distinct(), "skill_id", "left_semi").groupBy("query_id", "skill_id").agg(F.min("rank").alias("rank"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "skill_id")))


def dcg(gain: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, gain / F.log2(rank + F.lit(1.0))).otherwise(0.0))


def per_query(gold: DataFrame, ranked: DataFrame, relevance: DataFrame | None = None) -> DataFrame:
    """(query_id, one column to a metric) for every query that has gold.

    ``relevance`` (query_id, skill_id, grade) gives graded gains to the queries it has rows for; others have gain 1.
    """
    golds = gold.select("query_id", "skill_id").distinct()
    rel = relevance if relevance is not None else gold.select("query_id", "skill_id", F.lit(0.0).alias("grade")).where(F.lit(False))
    graded = rel.groupBy("query_id").agg(F.count("*").alias("n_grades")).withColumn("graded", F.lit(True)).drop("n_grades")
    n_gold = golds.groupBy("query_id").agg(F.count("*").cast("double").alias("n_gold"))
    hits = (
        ranked.join(golds.withColumn("gold", F.lit(1.0)), ["query_id", "skill_id"], "left")
        .join(rel.select("query_id", "skill_id", "grade"), ["query_id", "skill_id"], "left")
        .join(graded, "query_id", "left")
        .select("query_id", "rank", F.coalesce("gold", F.lit(0.0)).alias("gold"), F.when(F.col("graded"), F.coalesce("grade", F.lit(0.0))).otherwise(F.coalesce("gold", F.lit(0.0))).alias("gain"))
    )
    rank, is_gold = F.col("rank"), F.col("gold") > 0
    upto = {k: F.sum(F.when(rank <= k, F.col("gold")).otherwise(0.0)) for k in (1, 3, 5, 10, 20, 50)}
    found = hits.groupBy("query_id").agg(*[dcg(F.col("gain"), rank, k).alias(f"dcg_{k}") for k in (1, 3, 10)], *[v.alias(f"hits_{k}") for k, v in upto.items()], F.min(F.when(is_gold & (rank <= 10), rank)).alias("first"))
    ideal_rows = rel.select("query_id", F.col("grade").alias("gain")).unionByName(golds.join(graded, "query_id", "left_anti").select("query_id", F.lit(1.0).alias("gain")))
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain")))
    ideal = ideal_rows.withColumn("rank", ideal_rank).where("rank <= 10").groupBy("query_id").agg(*[dcg(F.col("gain"), F.col("rank"), k).alias(f"ideal_{k}") for k in (1, 3, 10)])
    both = n_gold.join(found, "query_id", "left").join(ideal, "query_id", "left").fillna(0.0, [f"{p}_{k}" for p, ks in (("dcg", (1, 3, 10)), ("ideal", (1, 3, 10)), ("hits", upto)) for k in ks])
    ndcg = {f"ndcg_{k}": F.when(F.col(f"ideal_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).otherwise(0.0) for k in (1, 3, 10)}
    out = ndcg | {"hit_1": F.when(F.col("hits_1") > 0, 1.0).otherwise(0.0), "precision_3": F.col("hits_3") / 3.0, "mrr_10": F.coalesce(1.0 / F.col("first"), F.lit(0.0))}
    out |= {f"recall_{k}": F.col(f"hits_{k}") / F.col("n_gold") for k in (10, 20, 50)}
    out |= {f"full_coverage_{k}": F.when(F.col(f"hits_{k}") >= F.col("n_gold"), 1.0).otherwise(0.0) for k in (1, 3, 5, 10)}
    return both.select("query_id", *[F.round(out[m], 6).alias(m) for m in METRICS])


def strata_means(details: DataFrame) -> DataFrame:
    """Means of all metrics over all tasks and over each stratum, with the number of tasks; empty strata have no row."""
    sides = details.select(F.explode(F.array(F.lit("all"), F.col("stratum"))).alias("stratum"), *METRICS)
    return sides.groupBy("stratum").agg(*[F.round(F.avg(m), 6).alias(m) for m in METRICS], F.count("*").alias("count"))


class Evaluation(NamedTuple):
    #: (query_id, stratum, metrics)
    details: DataFrame
    #: (stratum, metrics, count)
    summary: DataFrame
    #: one row: skipped_generic_only, skipped_no_gt_in_pool, skipped_missing_prediction
    skipped: DataFrame


def evaluate(tasks: DataFrame, rankings: DataFrame, pool: DataFrame) -> Evaluation:
    """``tasks``: query_id, gold (array), generic_only or task_type, and optionally relevance (map of grades).

    Skips generic tasks, then tasks without gold in the pool, then tasks without a ranking. The stratum follows the whole
    gold set, the metrics only what is in the pool.
    """
    generic = [F.coalesce(F.col(c) == v, F.lit(False)) for c, v in (("generic_only", True), ("task_type", "generic_only")) if c in tasks.columns]
    in_pool = pool.select("skill_id").distinct()
    golds = tasks.select("query_id", F.explode("gold").alias("skill_id")).distinct().join(in_pool, "skill_id", "left_semi")
    flags = (
        tasks.select("query_id", reduce(or_, generic, F.lit(False)).alias("generic"), F.size("gold").alias("n_gold"))
        .join(golds.select("query_id").distinct().withColumn("has_gold", F.lit(True)), "query_id", "left")
        .join(rankings.select("query_id").distinct().withColumn("has_ranking", F.lit(True)), "query_id", "left")
        .withColumn("skip", F.when(F.col("generic"), "generic_only").when(F.col("has_gold").isNull(), "no_gt_in_pool").when(F.col("has_ranking").isNull(), "missing_prediction"))
    )
    skipped = flags.agg(*[F.count(F.when(F.col("skip") == s, 1)).alias(f"skipped_{s}") for s in ("generic_only", "no_gt_in_pool", "missing_prediction")])
    scored = flags.where("skip is null").select("query_id", F.when(F.col("n_gold") == 1, "single").otherwise("multi").alias("stratum"))
    relevance = None
    if "relevance" in tasks.columns:
        relevance = tasks.select("query_id", F.explode("relevance").alias("skill_id", "grade")).join(in_pool, "skill_id", "left_semi")
    details = scored.join(per_query(golds, ranked_in_pool(rankings, pool), relevance), "query_id")
    return Evaluation(details, strata_means(details), skipped)
