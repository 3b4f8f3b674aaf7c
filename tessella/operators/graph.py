"""Compositional candidates: which step's output another step needs, as pairs and triples of steps.

Everything stays relational: features are array columns, candidate edges come from an equi-join on rare artifact tokens,
limits are row numbers, triples are a self-join of the kept edges.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import hashing, text
from tessella.functions.fixed import ARTIFACT_STOP_WORDS, CONSUMER_ACTIONS, PRODUCER_ACTIONS


@dataclass(frozen=True)
class Limits:
    max_pairs: int = 31_977
    max_triples: int = 1_000
    max_pairs_per_source: int = 16
    max_artifact_frequency: int = 5

    def __post_init__(self):
        if min(self.max_pairs, self.max_triples, self.max_pairs_per_source, self.max_artifact_frequency) <= 0:
            raise ValueError("limits must be positive")


class Candidates(NamedTuple):
    eligible: DataFrame
    edges: DataFrame
    pairs: DataFrame
    triples: DataFrame
    #: (candidate_id, stage, skill_ids, reasons)
    rejections: DataFrame


def _array(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def eligibility(contracts: DataFrame, queries: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contracts`` (with ``contract_idx``) and the first reason that speaks against each; blank ids are left out."""
    fresh = queries.where("positive_skill_id <> '' and source_hash <> ''").select(F.col("positive_skill_id").alias("skill_id"), "source_hash").distinct().withColumn("fresh", F.lit(True))
    marked = contracts.where("skill_id <> ''").join(benchmark.select("skill_id").distinct().withColumn("in_benchmark", F.lit(True)), "skill_id", "left").join(fresh, ["skill_id", "source_hash"], "left")
    first = F.when(~F.col("extraction.status").eqNullSafe("validated"), "contract_not_validated").when(F.col("in_benchmark"), "benchmark_skill").when(F.col("fresh").isNull(), "missing_or_stale_single_skill_query")
    marked = marked.withColumn("reason", first)
    nth = F.row_number().over(Window.partitionBy("skill_id", F.col("reason").isNull()).orderBy("contract_idx"))
    return marked.withColumn("reason", F.coalesce("reason", F.when(nth > 1, "duplicate_contract"))).drop("in_benchmark", "fresh")


def features(contracts: DataFrame, tokenize=text.tokens) -> DataFrame:
    """Token sets of what each contract makes, needs, depends on and does."""
    stop = F.array(*map(F.lit, ARTIFACT_STOP_WORDS))

    def long_tokens(x: Column) -> Column:
        return F.filter(tokenize(text.coerce(x)), lambda t: F.length(t) >= 3)

    def artifacts(items: Column) -> Column:
        sets = F.transform(items, lambda i: F.array_distinct(F.filter(long_tokens(i["artifact"]), lambda t: ~F.array_contains(stop, t))))
        return F.filter(sets, lambda s: F.size(s) > 0)

    def formats(items: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(items, lambda i: text.fold(text.strip(text.coerce(i["format"])))), lambda f: f != ""))

    def named(items: Column, field: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(items, lambda i: long_tokens(i[field]))))

    outputs = F.coalesce(F.col("outputs"), F.filter("outputs", lambda x: F.lit(False)))
    inputs = F.filter("inputs", lambda i: i["required"].eqNullSafe(F.lit(True)))
    first = contracts.select("skill_id", artifacts(outputs).alias("out_sets"), artifacts(inputs).alias("in_sets"), formats(outputs).alias("out_formats"), formats(inputs).alias("in_formats"), named(F.col("dependencies"), "name").alias("dep_tokens"), named(F.col("operations"), "action").alias("actions"))
    none, no_sets = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    fill = [F.coalesce(c, no_sets if c.endswith("sets") else none).alias(c) for c in first.columns if c != "skill_id"]
    return first.select("skill_id", *fill).select("*", F.array_distinct(F.flatten("out_sets")).alias("out_tokens"), F.array_distinct(F.flatten("in_sets")).alias("in_tokens"))


def handoffs(targets: Column, deps: Column, formats_match: Column) -> Column:
    """Shared tokens of the artifact pairs that hand over for sure.

    ``targets``: array of (o, i) token sets. Equal sets, or two and more shared tokens that make half of the shorter set,
    or one shared token of at least four letters that is the whole shorter set and is backed by a dependency or a format.
    """

    def sure(p: Column) -> Column:
        both = F.array_intersect(p["o"], p["i"])
        shorter = F.least(F.size(p["o"]), F.size(p["i"]))
        same = (F.size(both) == F.size(p["o"])) & (F.size(both) == F.size(p["i"]))
        phrase = (F.size(both) >= 2) & (F.size(both) * 2 >= shorter)
        name = (F.size(both) == 1) & (shorter == 1) & (F.length(F.get(both, F.lit(0))) >= 4) & (F.array_contains(deps, F.get(both, F.lit(0))) | formats_match)
        return (F.size(both) > 0) & (same | phrase | name)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(targets, sure), lambda p: F.array_intersect(p["o"], p["i"])))))


def edge_candidates(feats: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every blocked pair of steps with its score, or with the reason that it is rejected."""
    out_tokens = feats.select(F.col("skill_id").alias("from_skill_id"), F.explode("out_tokens").alias("token"))
    frequency = out_tokens.groupBy("token").agg(F.count("*").alias("df"))
    rare = out_tokens.join(frequency.where(F.col("df") <= limits.max_artifact_frequency), "token")
    needs = feats.select(F.col("skill_id").alias("to_skill_id"), F.explode("in_tokens").alias("token"))
    blocked = rare.join(needs, "token").where("from_skill_id <> to_skill_id").select("from_skill_id", "to_skill_id").distinct()
    source = feats.select(F.col("skill_id").alias("from_skill_id"), "out_sets", "out_formats", "out_tokens", F.col("actions").alias("from_actions"))
    target = feats.select(F.col("skill_id").alias("to_skill_id"), "in_sets", "in_formats", "dep_tokens", F.col("actions").alias("to_actions"))
    both = blocked.join(source, "from_skill_id").join(target, "to_skill_id")
    pairs = F.flatten(F.transform("out_sets", lambda o: F.transform("in_sets", lambda i: F.struct(o.alias("o"), i.alias("i")))))
    both = both.withColumn("matched_formats", F.array_sort(F.array_intersect("out_formats", "in_formats")))
    both = both.withColumn("matched_artifact_tokens", handoffs(pairs, F.col("dep_tokens"), F.size("matched_formats") > 0))
    words = lambda ws: F.array(*map(F.lit, ws))
    relation = F.when(~F.arrays_overlap("to_actions", words(CONSUMER_ACTIONS)), F.lit(None)).when(F.arrays_overlap("from_actions", words(PRODUCER_ACTIONS)), "producer_to_consumer").otherwise("artifact_handoff_to_consumer")
    both = both.select("from_skill_id", "to_skill_id", "matched_artifact_tokens", "matched_formats", F.array_sort(F.array_intersect("out_tokens", "dep_tokens")).alias("matched_dependency_tokens"), relation.alias("operation_relation"))
    both = both.withColumn("reason", F.when(F.size("matched_artifact_tokens") == 0, "weak_artifact_handoff").when(F.col("operation_relation").isNull(), "missing_complementary_operation"))
    rarity = both.where("reason is null").select("from_skill_id", "to_skill_id", F.explode("matched_artifact_tokens").alias("token")).join(frequency, "token").groupBy("from_skill_id", "to_skill_id").agg(F.sum(1 / F.col("df")).alias("rarity"))
    scored = both.join(rarity, ["from_skill_id", "to_skill_id"], "left")
    return scored.withColumn("score", F.when(F.col("reason").isNull(), F.bround(F.lit(6.0) + F.col("rarity") + F.size("matched_formats") + F.size("matched_dependency_tokens"), 6))).drop("rarity")


def rejection(rows: DataFrame, stage: str, ids: list[str], reason: Column) -> DataFrame:
    key = hashing.candidate_id(stage, *[F.col(i) for i in ids])
    return rows.select(key.alias("candidate_id"), F.lit(stage).alias("stage"), F.array(*ids).alias("skill_ids"), F.array(reason).alias("reasons"))


def first_ranked(rows: DataFrame, n: int, order: list, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows with their rank, and the others.

    A limit after a sort keeps ``n`` rows to a task and only these are numbered in one task; the rest is never sorted.
    """
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))), rows.join(top.select(*keys), keys, "left_anti")


def build(contracts: DataFrame, queries: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), tokenize=text.tokens) -> Candidates:
    """Eligible contracts to pairs, triples and rejections."""
    checked = eligibility(contracts, queries, benchmark)
    eligible = checked.where("reason is null").drop("reason")
    edges = edge_candidates(features(eligible, tokenize), limits)
    good = edges.where("reason is null").drop("reason")
    per_source = good.withColumn("nth", F.row_number().over(Window.partitionBy("from_skill_id").orderBy(F.desc("score"), "to_skill_id")))
    kept = per_source.where(F.col("nth") <= limits.max_pairs_per_source).drop("nth")
    pair_ids = ["from_skill_id", "to_skill_id"]
    ranked, more_pairs = first_ranked(kept, limits.max_pairs, [F.desc("score"), *pair_ids], pair_ids)
    pairs = ranked.select(hashing.candidate_id("pair", F.col("from_skill_id"), F.col("to_skill_id")).alias("candidate_id"), F.lit("pair").alias("candidate_type"), F.array("from_skill_id", "to_skill_id").alias("skill_ids"), "score", "rank")
    a = kept.select(F.col("from_skill_id").alias("first"), F.col("to_skill_id").alias("second"), F.col("score").alias("score1"))
    b = kept.select(F.col("from_skill_id").alias("second"), F.col("to_skill_id").alias("third"), F.col("score").alias("score2"))
    paths = a.join(b, "second").where("first <> third").withColumn("score", F.bround(F.col("score1") + F.col("score2"), 6))
    triple_ids = ["first", "second", "third"]
    ranked_triples, more_triples = first_ranked(paths, limits.max_triples, [F.desc("score"), *triple_ids], triple_ids)
    triples = ranked_triples.select(hashing.candidate_id("triple", F.col("first"), F.col("second"), F.col("third")).alias("candidate_id"), F.lit("triple").alias("candidate_type"), F.array("first", "second", "third").alias("skill_ids"), "score", "rank")
    rejected = [
        rejection(checked.where("reason is not null"), "eligibility", ["skill_id"], F.col("reason")),
        rejection(edges.where("reason is not null"), "pair_validation", pair_ids, F.col("reason")),
        rejection(per_source.where(F.col("nth") > limits.max_pairs_per_source), "pair_selection", pair_ids, F.lit("source_pair_limit")),
        rejection(more_pairs, "pair_selection", pair_ids, F.lit("global_pair_limit")),
        rejection(more_triples, "triple_selection", triple_ids, F.lit("global_triple_limit")),
    ]
    rejections = rejected[0]
    for more in rejected[1:]:
        rejections = rejections.unionByName(more)
    return Candidates(eligible, kept, pairs, triples, rejections)
