"""Training sets: bi-encoder examples, reranker groups, their mixture, summaries and losses."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators.lineage import cut, few


def biencoder_examples(records: DataFrame, negatives: DataFrame, skills: DataFrame, max_negatives: int = 10) -> DataFrame:
    """One row a record: formatted query, positive and up to ``max_negatives`` negatives.

    ``records``: query_id, query, positive_skill_id, positives (array), training_type, loss_weight; ``negatives``:
    query_id, skill_id, source, position. Positives and repeats are no negatives; an unknown skill is an error.
    """
    known = lambda c: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit("unknown skill")))
    first = Window.partitionBy("query_id", "skill_id").orderBy("position")
    valid = negatives.join(records.select("query_id", "positives"), "query_id").where(~F.array_contains("positives", F.col("skill_id"))).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    # the limit comes before the texts are joined, and only texts that are asked for are moved
    limited = cut(valid.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("at") <= max_negatives))
    asked = few(cut(limited.select("skill_id").unionByName(records.select(F.col("positive_skill_id").alias("skill_id"))).distinct()))
    texts = skills.join(asked, "skill_id", "left_semi").select("skill_id", text.format_skill("name", "description", "body").alias("skill_text"))
    kept = limited.join(texts, "skill_id", "left")
    lists = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "skill_id", known(F.col("skill_text")).alias("text"), "source"))).alias("n"))
    side = texts.withColumnsRenamed({"skill_id": "positive_skill_id", "skill_text": "positive_text"})
    joined = records.join(side, "positive_skill_id", "left").join(lists, "query_id", "left")
    none = F.array().cast("array<string>")
    return joined.select("query_id", text.format_query("query").alias("query_text"), "positive_skill_id", known(F.col("positive_text")).alias("positive_text"), F.coalesce("n.skill_id", none).alias("negative_skill_ids"), F.coalesce("n.text", none).alias("negative_texts"), F.coalesce("n.source", none).alias("negative_sources"), F.coalesce("training_type", F.lit("single")).alias("training_type"), F.coalesce("loss_weight", F.lit(1.0)).alias("loss_weight"))


class Groups(NamedTuple):
    #: (query_id, skill_id, rank, retrieval_score, label)
    candidates: DataFrame
    #: one row: groups, dropped
    counts: DataFrame


def reranker_groups(candidates: DataFrame, positives: DataFrame, skills: DataFrame, top_k: int = 20) -> Groups:
    """Known candidates without repeats, the first ``top_k`` of each query ranked anew and labelled.

    Queries without a positive among them are dropped and counted.
    """
    known = candidates.join(skills.select("skill_id"), "skill_id", "left_semi")
    once = known.groupBy("query_id", "skill_id").agg(F.min(F.struct("rank", F.col("score"))).alias("first"))
    order = Window.partitionBy("query_id").orderBy("first.rank", "skill_id")
    top = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    labelled = top.join(positives.select("query_id", "skill_id").distinct().withColumn("label", F.lit(1)), ["query_id", "skill_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    good = labelled.groupBy("query_id").agg(F.max("label").alias("has"))
    counts = candidates.select("query_id").distinct().join(good, "query_id", "left").agg(F.count(F.when(F.col("has") == 1, 1)).alias("groups"), F.count(F.when(F.coalesce("has", F.lit(0)) == 0, 1)).alias("dropped"))
    kept = labelled.join(good.where("has = 1").select("query_id"), "query_id", "left_semi")
    return Groups(kept.select("query_id", "skill_id", "rank", F.col("first.score").alias("retrieval_score"), "label"), counts)


def materialize_groups(groups: DataFrame, queries: DataFrame, skills: DataFrame, form: str = "flat-full") -> DataFrame:
    """Groups with the prompt of every candidate; texts are joined to the few rows that are left."""
    joined = groups.join(queries.select("query_id", "query"), "query_id").join(skills, "skill_id")
    return joined.select("query_id", "skill_id", "rank", "label", text.rerank_prompt("query", "name", "description", "body", form).alias("prompt"))


class Mixed(NamedTuple):
    biencoder: DataFrame
    reranker: DataFrame


def mix(single: DataFrame, multi: DataFrame, biencoder_weight: float = 1.5, reranker_weight: float = 3.0) -> Mixed:
    """Single- and multi-positive records in one training set.

    A multi query stands once for each positive in the bi-encoder's set and once in the reranker's.
    ``single``: query_id, query, positive_skill_id; ``multi``: query_id, query, positives (array).
    """
    if min(biencoder_weight, reranker_weight) <= 0:
        raise ValueError("weights must be positive")
    one = single.select("query_id", F.col("query_id").alias("source_query_id"), "query", "positive_skill_id", F.array("positive_skill_id").alias("positives"), F.lit("single").alias("training_type"), F.lit(1.0).alias("loss_weight"))
    each = multi.select(F.col("query_id").alias("source_query_id"), "query", "positives", F.posexplode("positives").alias("i", "positive_skill_id"))
    many = each.select(F.concat_ws("::", "source_query_id", F.concat(F.lit("positive-"), (F.col("i") + 1).cast("string"))).alias("query_id"), "source_query_id", "query", "positive_skill_id", "positives", F.lit("multi").alias("training_type"), F.lit(float(biencoder_weight)).alias("loss_weight"))
    groups = one.select("query_id", "query", "positives", "training_type", "loss_weight").unionByName(multi.select("query_id", "query", "positives", F.lit("multi").alias("training_type"), F.lit(float(reranker_weight)).alias("loss_weight")))
    return Mixed(one.unionByName(many), groups)


def summary(examples: DataFrame) -> DataFrame:
    """Counts, weighted mass and mean weight by training type."""
    return examples.groupBy("training_type").agg(F.count("*").alias("n"), F.round(F.sum("loss_weight"), 6).alias("mass"), F.round(F.avg("loss_weight"), 6).alias("mean_weight"))


def longest_group(groups: DataFrame, prompt: Column | str = "prompt") -> DataFrame:
    """The query whose longest prompt is longest; the first by query_id of equals."""
    return groups.groupBy("query_id").agg(F.max(F.length(prompt)).alias("longest")).orderBy(F.desc("longest"), "query_id").limit(1)


def info_nce(similarities: DataFrame, temperature: float) -> DataFrame:
    """(query_id, loss) of (query_id, similarity, positive): cross-entropy of the positive among all of the query's rows."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    logits = similarities.withColumn("x", F.col("similarity") / temperature).withColumn("most", F.max("x").over(Window.partitionBy("query_id")))
    return _by_parts(logits, "positive")


def listwise(scores: DataFrame) -> DataFrame:
    """(query_id, loss) of (query_id, score, positive): log-sum-exp of all scores less that of the positives."""
    logits = scores.withColumn("x", F.col("score").cast("double")).withColumn("most", F.max(F.col("score").cast("double")).over(Window.partitionBy("query_id")))
    return _by_parts(logits, "positive")


def _by_parts(logits: DataFrame, positive: str) -> DataFrame:
    e = F.exp(F.col("x") - F.col("most"))
    sums = logits.groupBy("query_id").agg(F.sum(e).alias("every"), F.sum(F.when(F.col(positive), e)).alias("good"))
    checked = F.when(F.col("good").isNotNull(), F.col("good")).otherwise(F.raise_error(F.lit("a group needs a positive")).cast("double"))
    return sums.select("query_id", F.round(F.log("every") - F.log(checked), 6).alias("loss"))
