"""First-stage retrieval over skills: lexical, dense and hybrid rankings, their export and their score.

A skill is indexed by its retrieval text, name | description | body, cut as ``text.format_skill`` does. ``skills`` has
skill_id, pool_idx (the order in which ties and padding go), name, description and body; ``queries`` has query_id and query.
Every ranking is (query_id, skill_id, score, rank).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions import text
from tessella.operators import bm25, dense, fusion, metrics
from tessella.operators.lineage import cut
from tessella.sources import jsonl


def _named(ranking: DataFrame, skills: DataFrame) -> DataFrame:
    return ranking.join(skills.select("pool_idx", "skill_id"), "pool_idx").select("query_id", "skill_id", "score", "rank")


def lexical(skills: DataFrame, queries: DataFrame, top_k: int, tokenize=text.tokens) -> DataFrame:
    """The best ``top_k`` by BM25, filled up with skills of score 0 in pool order."""
    return _named(bm25.topk(skills, text.format_skill("name", "description", "body"), queries, "query", top_k, tokenize=tokenize), skills)


def semantic(skills: DataFrame, skill_vectors: DataFrame, query_vectors: DataFrame, top_k: int) -> DataFrame:
    """The best ``top_k`` by cosine of (pool_idx, embedding) and (query_id, embedding)."""
    return _named(dense.semantic_topk(query_vectors, skill_vectors, top_k), skills)


def hybrid(skills: DataFrame, queries: DataFrame, skill_vectors: DataFrame, query_vectors: DataFrame, top_k: int = 50, depth: int = 100, rrf_k: int = 60, tokenize=text.tokens) -> DataFrame:
    """Lexical and dense rankings of ``depth`` each (padding included), fused by reciprocal ranks."""
    if depth < top_k:
        raise ValueError("depth must be top_k or more")
    both = [lexical(skills, queries, depth, tokenize), semantic(skills, skill_vectors, query_vectors, depth)]
    return fusion.reciprocal_rank_fusion(both, top_k, rrf_k)


def predictions(ranking: DataFrame) -> DataFrame:
    """(query_id, skill_ids) in the order of the ranks."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "skill_id")))
    return ranking.groupBy("query_id").agg(F.transform(ordered, lambda x: x["skill_id"]).alias("skill_ids"))


def records(ranking: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, positive_skill_id, positive_skill_ids, retrieved_candidates), a row to each query, ranked or not.

    The positives are those of ``positive_skill_id`` and ``positive_skill_ids`` together, sorted, where queries have them.
    """
    none = F.lit(None)
    one = F.col("positive_skill_id") if "positive_skill_id" in queries.columns else none.cast("string")
    many = F.coalesce("positive_skill_ids", F.array().cast("array<string>")) if "positive_skill_ids" in queries.columns else F.array().cast("array<string>")
    together = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(one), many))))
    lists = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "skill_id", "score"))).alias("retrieved_candidates"))
    return queries.select("query_id", "query", one.alias("positive_skill_id"), together.alias("positive_skill_ids")).join(lists, "query_id", "left")


def score(tasks: DataFrame, ranking: DataFrame, skills: DataFrame) -> metrics.Evaluation:
    """Metrics by query and by stratum, and how many tasks were skipped and why (see ``metrics.evaluate``)."""
    return metrics.evaluate(tasks, ranking, skills)


def write_outputs(ranking: DataFrame, queries: DataFrame, predictions_path: str, records_path: str, overwrite: bool = False) -> dict:
    """Writes predictions and records as JSON lines, one a query; returns how many of each and where they are."""
    spark = ranking.sparkSession
    jsonl.guard_outputs(spark, [predictions_path, records_path], overwrite)
    kept = cut(ranking.select("query_id", "skill_id", "score", "rank"))
    n = {"predictions": jsonl.write_atomic(predictions(kept), predictions_path, overwrite), "queries": jsonl.write_atomic(records(kept, queries), records_path, overwrite)}
    return n | {"predictions_path": predictions_path, "records_path": records_path}


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, skill_id, rank) from written predictions."""
    rows = jsonl.read(spark, path, StructType.fromDDL("query_id string, skill_ids array<string>"))
    return rows.select("query_id", F.posexplode("skill_ids").alias("at", "skill_id")).select("query_id", "skill_id", (F.col("at") + 1).alias("rank"))


def write_score(tasks: DataFrame, ranking: DataFrame, skills: DataFrame, folder: str, stage: str = "retrieval", benchmark: str = "hard", overwrite: bool = False) -> dict:
    """Scores a ranking and writes ``summary.json`` and the details of every scored task to ``folder``; returns the summary.

    The summary has the means by stratum (three rows at most come to the driver) and the skipped tasks by reason.
    """
    spark = tasks.sparkSession
    jsonl.guard_outputs(spark, [f"{folder}/summary.json"], overwrite)
    found = score(tasks, ranking, skills)
    details = cut(found.details)
    jsonl.write_atomic(details, f"{folder}/details", overwrite)
    means = {r.stratum: {k: v for k, v in r.asDict().items() if k != "stratum"} for r in metrics.strata_means(details).collect()}
    summary = {"stage": stage, "benchmark": benchmark, "metrics": means, **found.skipped.first().asDict()}
    jsonl.write_json(spark, summary, f"{folder}/summary.json")
    return summary
