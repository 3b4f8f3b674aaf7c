"""Hard negatives: identity and false-negative filters, quota scans over ordered sources, and merging of sources.

A quota scan walks the candidates of a source in order, passes over what an earlier source took or threw out, and stops at
its target. As windows: a candidate is *scanned* when fewer than ``target`` candidates before it passed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import bm25, guards, permutation
from tessella.operators.dense import cosine, semantic_topk
from tessella.operators.lineage import cut, few

LOCAL_SOURCES = (("bm25", 3), ("same_category", 2), ("random", 1))
MERGED_SOURCES = (("semantic", 4), ("bm25", 3), ("same_category", 2), ("random", 1))


def with_identity(skills: DataFrame) -> DataFrame:
    """``skills`` with what the identity filter compares, worked out once a row: name_key, body_key, grams.

    Grams are 64-bit hashes of the trigrams: longs intersect faster than strings and collide next to never.
    """
    body = text.strip(text.coerce("body"))
    return skills.select("skill_id", text.normalized(text.coerce("name")).alias("name_key"), body.alias("body_key"), F.transform(text.trigrams(body), lambda g: F.xxhash64(g)).alias("grams"))


def identity_reason(threshold: float, p: str = "p", c: str = "c") -> Column:
    """Why candidate ``c`` is the same as positive ``p``, or null; both are rows of ``with_identity``."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    pos, cand = (lambda f: F.col(f"{p}.{f}")), (lambda f: F.col(f"{c}.{f}"))
    # sizes bound the overlap from above, so most pairs need no intersection
    reachable = F.least(F.size(pos("grams")), F.size(cand("grams"))) >= F.lit(threshold) * F.greatest(F.size(pos("grams")), F.size(cand("grams")))
    overlap = F.when((F.size(pos("grams")) > 0) & (cand("body_key") != "") & reachable, text.jaccard(pos("grams"), cand("grams")))
    return (
        F.when(pos("skill_id") == cand("skill_id"), "same_skill_id")
        .when((pos("name_key") != "") & (pos("name_key") == cand("name_key")), "same_normalized_name")
        .when((pos("body_key") != "") & (pos("body_key") == cand("body_key")), "same_body")
        .when(overlap >= threshold, "high_body_trigram_overlap")
    )


class Filtered(NamedTuple):
    kept: DataFrame
    removed: DataFrame


def filter_identity(pairs: DataFrame, skills: DataFrame, threshold: float = 0.85) -> Filtered:
    """Splits (query_id, positive_skill_id, skill_id, ...) by ``identity_reason``."""
    flagged = flag_identity(pairs, skills, threshold)
    return Filtered(flagged.where("reason is null").drop("reason"), flagged.where("reason is not null"))


def flag_identity(pairs: DataFrame, skills: DataFrame, threshold: float = 0.85) -> DataFrame:
    pairs = cut(pairs)
    # only skills of a pair are normalised
    named = few(cut(pairs.select(F.col("positive_skill_id").alias("skill_id")).unionByName(pairs.select("skill_id")).distinct()))
    side = with_identity(skills.join(named, "skill_id", "left_semi"))
    both = pairs.join(side.select(F.struct("*").alias("p"), F.col("skill_id").alias("positive_skill_id")), "positive_skill_id").join(side.select(F.struct("*").alias("c"), "skill_id"), "skill_id")
    return both.withColumn("reason", identity_reason(threshold)).drop("p", "c")


def filter_false_negatives(candidates: DataFrame, embeddings: DataFrame, threshold: float = 0.95, scope: str = "semantic_topk") -> Filtered:
    """Removes candidates as similar as ``threshold`` to a positive of their query, by the first such positive.

    ``candidates``: query_id, skill_id, positives (array in order) and more; ``embeddings``: skill_id, embedding. Removed
    rows are review rows with positive_skill_id, score and filter_scope. A missing embedding is an error.
    """
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must be between -1 and 1")
    pairs = candidates.select("query_id", "skill_id", F.posexplode("positives").alias("at", "positive_skill_id")).distinct()
    vectors = embeddings.select("skill_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    there = pairs.join(vectors, "skill_id", "left").join(vectors.select(F.col("skill_id").alias("positive_skill_id"), F.col("v").alias("w")), "positive_skill_id", "left")
    known = F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), cosine(F.col("v"), F.col("w"))).otherwise(F.raise_error(F.concat(F.lit("no embedding for a candidate or positive of query "), F.col("query_id").cast("string"))).cast("double"))
    hits = there.withColumn("similarity", known).where(F.col("similarity") >= threshold)
    first = hits.groupBy("query_id", "skill_id").agg(F.min_by(F.struct("positive_skill_id", "similarity"), "at").alias("hit"))
    joined = candidates.join(first, ["query_id", "skill_id"], "left")
    removed = joined.where("hit is not null").select("query_id", F.col("hit.positive_skill_id").alias("positive_skill_id"), "skill_id", F.lit("embedding_false_negative").alias("reason"), F.col("hit.similarity").alias("score"), *(["source"] if "source" in candidates.columns else []), F.lit(scope).alias("filter_scope"))
    return Filtered(joined.where("hit is null").drop("hit"), removed)


def scan(candidates: DataFrame, target: int) -> DataFrame:
    """The candidates that a scan reaches: (.., passes, ..) rows with fewer than ``target`` passing rows before them."""
    before = F.sum(F.col("passes").cast("int")).over(Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return candidates.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < target).drop("before")


class Mined(NamedTuple):
    #: (query_id, skill_id, source, score, position)
    negatives: DataFrame
    #: (query_id, skill_id, reason, source)
    filtered: DataFrame


#: The lists of ``asked`` queries to a width: (query_id, skill_id, score, position), and whether all of them are whole.
Lists = Callable[[DataFrame, int], tuple[DataFrame, bool]]


def head_then_rest(head: DataFrame, queries: DataFrame, skills: DataFrame, tail: int) -> DataFrame:
    """(query_id, skill_id, score, position): the ranked head, then the first ``tail`` other rows by skill_id."""
    first = head.select("query_id", "skill_id", "score", F.col("rank").cast("long").alias("position"))
    rest = queries.select("query_id").crossJoin(_first_ids(skills, tail)).join(first.select("query_id", "skill_id"), ["query_id", "skill_id"], "left_anti")
    return first.unionByName(rest.select("query_id", "skill_id", F.lit(0.0).alias("score"), (F.col("at") + 1_000_000).cast("long").alias("position")))


def _first_ids(skills: DataFrame, n: int) -> DataFrame:
    """(skill_id, at): the first ``n`` by skill_id; more than a few are numbered within ranges, not in one task."""
    if n <= 4096:
        return F.broadcast(skills.select("skill_id").orderBy("skill_id").limit(n).withColumn("at", F.row_number().over(Window.orderBy("skill_id"))))
    placed = cut(skills.select("skill_id").repartitionByRange("skill_id").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    start = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("skill_id")) + F.col("start")
    return placed.join(F.broadcast(start), "part").select("skill_id", at.alias("at")).where(F.col("at") <= n)


def mine_local(queries: DataFrame, skills: DataFrame, seed: int = 42, threshold: float = 0.85, head: int = 256, prefix: int = 64, tokenize=text.tokens) -> Mined:
    """Negatives of each query from the best lexical matches, its positive's category and at random.

    ``queries``: query_id, query, positive_skill_id. Lists beyond the lexical head are read to a ``prefix`` in their own
    order; queries whose quota it doesn't fill get wider ones, up to the whole list.
    """
    pool = skills.where("skill_id <> ''")
    positives = queries.select("query_id", "positive_skill_id")
    lists = _lists(queries, positives, pool, seed, head, prefix, tokenize)
    kept: DataFrame | None = None
    out: DataFrame | None = None
    for source, target in LOCAL_SOURCES:

        def mark(rows: DataFrame, kept=kept, out=out) -> DataFrame:
            fresh = rows if kept is None else rows.join(kept.select("query_id", "skill_id").unionByName(out.select("query_id", "skill_id")), ["query_id", "skill_id"], "left_anti")
            return flag_identity(fresh.join(positives, "query_id"), pool, threshold).withColumn("passes", F.col("reason").isNull())

        seen = _filled(lists[source], queries.select("query_id"), mark, target, prefix).withColumn("source", F.lit(source))
        good = seen.where("passes").select("query_id", "skill_id", "source", "score", "position")
        bad = seen.where("not passes").select("query_id", "skill_id", "reason", "source")
        kept = good if kept is None else kept.unionByName(good)
        out = bad if out is None else out.unionByName(bad)
    return Mined(kept, out)


def _lists(queries: DataFrame, positives: DataFrame, pool: DataFrame, seed: int, head: int, prefix: int, tokenize) -> dict[str, Lists]:
    """The local sources. Lists of a greater width begin with those of a smaller."""
    lexical = cut(bm25.rank(pool, text.search_text("name", "description", "body"), queries, "query", head, tokenize=tokenize).join(pool.select("pool_idx", "skill_id"), "pool_idx").select("query_id", "skill_id", "score", "rank"))
    keyed = cut(permutation.numbered(pool.select("skill_id", F.coalesce(text.category("category", "skill_id"), F.lit("")).alias("category")), "skill_id", "category"))
    sizes = cut(keyed.groupBy("category").agg(F.count("*").alias("n")))
    size = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of = cut(positives.join(keyed.select(F.col("skill_id").alias("positive_skill_id"), "category"), "positive_skill_id").select("query_id", "category").distinct().join(F.broadcast(sizes), "category"))

    def ranked(asked: DataFrame, width: int) -> tuple[DataFrame, bool]:
        own = lexical.join(asked, "query_id", "left_semi")
        if width <= head and width < size:
            # a scan mostly ends in the first rows of the head, so only these are compared at first
            return own.where(F.col("rank") <= width).select("query_id", "skill_id", "score", F.col("rank").cast("long").alias("position")), False
        return head_then_rest(own, asked, pool, width), width >= size

    def mates(asked: DataFrame, width: int) -> tuple[DataFrame, bool]:
        own = of.join(asked, "query_id", "left_semi")
        most = own.agg(F.max("n")).first()[0] or 0
        drawn_ = permutation.order(own, "n", width, seed, F.col("query_id"), "category", F.col("category")).withColumnRenamed("number", "mate")
        # queries of several categories take their orders in turn
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("position", "category"))
        rows = drawn_.join(keyed.select("skill_id", "category", "mate"), ["category", "mate"])
        return rows.select("query_id", "skill_id", F.lit(0.0).alias("score"), place.cast("long").alias("position")), width >= _whole(most)

    def drawn(asked: DataFrame, width: int) -> tuple[DataFrame, bool]:
        rows = permutation.order(asked.withColumn("n", F.lit(size)), "n", width, seed, F.col("query_id"), "random")
        return rows.join(keyed.select("skill_id", "number"), "number").select("query_id", "skill_id", F.lit(0.0).alias("score"), "position"), width >= _whole(size)

    return {"bm25": ranked, "same_category": mates, "random": drawn}


def _filled(lists: Lists, asked: DataFrame, mark: Callable[[DataFrame], DataFrame], target: int, prefix: int) -> DataFrame:
    """What a scan reaches of the marked lists, which widen for those queries that aren't filled until they are whole."""
    out: DataFrame | None = None
    width = prefix
    while True:
        rows, whole = lists(asked, width)
        seen = cut(scan(mark(rows), target))
        if whole:
            return seen if out is None else out.unionByName(seen)
        full = seen.where("passes").groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= target)
        asked = cut(asked.join(full, "query_id", "left_anti"))
        if asked.isEmpty():
            return seen if out is None else out.unionByName(seen)
        done = seen.join(asked, "query_id", "left_anti")
        out = done if out is None else out.unionByName(done)
        width *= 8


def _whole(n: int) -> int:
    """The width at which an order of n holds all of it."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a * -(-n // a)


def unfilled(mined: Mined, queries: DataFrame, sources=LOCAL_SOURCES) -> DataFrame:
    """(query_id, source, found, target) where a source gave fewer than its target."""
    want = queries.select("query_id").crossJoin(queries.sparkSession.createDataFrame(list(sources), "source string, target int"))
    have = mined.negatives.groupBy("query_id", "source").agg(F.count("*").alias("found"))
    return want.join(have, ["query_id", "source"], "left").fillna(0, ["found"]).where("found < target")


def merge_sources(candidates: DataFrame, positives: DataFrame, sources=MERGED_SOURCES) -> DataFrame:
    """Up to each source's quota in the sources' order, every skill once and no positive.

    A skill beyond the quota of one source can still be taken from a later one, so the sources go one after another.
    ``candidates``: query_id, source, skill_id, score, position.
    """
    valid = candidates.where("skill_id is not null and skill_id <> ''").join(positives.select("query_id", F.col("positive_skill_id").alias("skill_id")), ["query_id", "skill_id"], "left_anti")
    first = Window.partitionBy("query_id", "source", "skill_id").orderBy("position")
    once = cut(valid.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth"))
    taken: DataFrame | None = None
    for source, quota in sources:
        rows = once.where(F.col("source") == source)
        if taken is not None:
            rows = rows.join(taken.select("query_id", "skill_id"), ["query_id", "skill_id"], "left_anti")
        picked = cut(rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("nth") <= quota).drop("nth"))
        taken = picked if taken is None else taken.unionByName(picked)
    return taken


def mine_semantic(local: DataFrame, semantic: DataFrame, positives: DataFrame, embeddings: DataFrame, threshold: float = 0.95) -> Filtered:
    """Merges local negatives with semantic candidates, then drops likely false negatives (without filling up again)."""
    cols = ["query_id", "source", "skill_id", "score", "position"]
    both = local.select(cols).unionByName(semantic.withColumn("source", F.lit("semantic")).select(cols))
    merged = merge_sources(both, positives)
    held = merged.join(positives.select("query_id", F.array("positive_skill_id").alias("positives")), "query_id")
    return filter_false_negatives(held, embeddings, threshold)


def semantic_candidates(queries: DataFrame, skills: DataFrame, k: int, threshold: float = 0.95) -> Filtered:
    """The ``k`` most similar skills of each query with several positives, less likely false negatives.

    ``queries``: query_id, embedding, positives (array of ids, each once); ``skills``: skill_id, pool_idx, embedding. Kept rows
    have source and position in the full list; removed ones are review rows of the scope ``semantic_topk``, by the first
    positive that is too similar. Positives themselves are as similar as can be, so they are among the removed.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = guards.checked(
        guards.required(queries, "query_id", "query_id"),
        (F.coalesce(F.size("positives"), F.lit(-1)) < 1, F.raise_error(F.concat(F.lit("no positives: "), "query_id")).cast("boolean")),
        (F.size(F.array_distinct("positives")) < F.size("positives"), F.raise_error(F.concat(F.lit("a positive id repeats: "), "query_id")).cast("boolean")),
    )
    top = semantic_topk(asked.select("query_id", "embedding"), skills.select("pool_idx", "embedding"), k)
    named = top.join(skills.select("pool_idx", "skill_id"), "pool_idx").join(asked.select("query_id", "positives"), "query_id")
    rows = cut(named.select("query_id", "skill_id", F.lit("semantic").alias("source"), "score", F.col("rank").cast("long").alias("position"), "positives"))
    found = filter_false_negatives(rows, skills.select("skill_id", "embedding"), threshold, "semantic_topk")
    return Filtered(found.kept.drop("positives"), found.removed)


class MultiMined(NamedTuple):
    negatives: DataFrame
    reviews: DataFrame


def mine_multi(queries: DataFrame, skills: DataFrame, semantic: DataFrame, embeddings: DataFrame, seed: int = 42, threshold: float = 0.85, false_negative: float = 0.95, head: int = 256, prefix: int = 64, tokenize=text.tokens) -> MultiMined:
    """Negatives of queries with several positives; a candidate must pass both filters against every positive.

    ``queries``: query_id, query, positives (array). Sources are scanned on until their quota is filled or their list ends (the
    whole pool or category; of ``semantic`` the rows given). Reviews are the
    candidates that were scanned and fell to the false-negative filter, once to a query, by the source that met them first.
    """
    pool = skills.where("skill_id <> ''")
    each = queries.select("query_id", F.explode("positives").alias("positive_skill_id"))
    lists = _lists(queries, each, pool, seed, head, prefix, tokenize)
    given = semantic.select("query_id", "skill_id", "score", "position")
    lists["semantic"] = lambda asked, width: (given, True)
    kept: DataFrame | None = each.select("query_id", F.col("positive_skill_id").alias("skill_id"))
    negatives: DataFrame | None = None
    reviews: DataFrame | None = None
    for source, quota in MERGED_SOURCES:

        def mark(rows: DataFrame, kept=kept, source=source) -> DataFrame:
            fresh = rows.join(kept, ["query_id", "skill_id"], "left_anti").withColumn("source", F.lit(source))
            flagged = flag_identity(fresh.join(each, "query_id"), pool, threshold)
            passed = cut(flagged.groupBy("query_id", "skill_id", "source", "score", "position").agg(F.bool_and(F.col("reason").isNull()).alias("own")))
            split = filter_false_negatives(passed.where("own").join(queries.select("query_id", "positives"), "query_id"), embeddings, false_negative, "selected_all_sources")
            return passed.join(split.removed.select("query_id", "skill_id", F.struct("positive_skill_id", F.col("score").alias("similarity")).alias("hit")), ["query_id", "skill_id"], "left").withColumn("passes", F.col("own") & F.col("hit").isNull())

        seen = _filled(lists[source], queries.select("query_id"), mark, quota, prefix)
        good = seen.where("passes").select("query_id", "skill_id", "source", "score", "position")
        review = seen.where("own and hit is not null").select("query_id", "skill_id", "source", F.col("hit.positive_skill_id").alias("positive_skill_id"), F.col("hit.similarity").alias("score"))
        kept = kept.unionByName(good.select("query_id", "skill_id"))
        negatives = good if negatives is None else negatives.unionByName(good)
        reviews = review if reviews is None else reviews.unionByName(review.join(reviews.select("query_id", "skill_id"), ["query_id", "skill_id"], "left_anti"))
    return MultiMined(negatives, reviews.withColumn("filter_scope", F.lit("selected_all_sources")))
