"""Deterministic stratified samples, even pilot selections and benchmark ids."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import hashing, text
from tessella.operators.lineage import cut
from tessella.functions.fixed import BENCHMARK_ID_FIELDS


class Sample(NamedTuple):
    #: The chosen rows with ``stratum`` and their ``position`` in a seeded order.
    records: DataFrame
    #: (stratum, population, selected)
    strata: DataFrame
    #: one row: excluded, duplicates
    counts: DataFrame


def benchmark_ids(tasks: DataFrame) -> DataFrame:
    """(skill_id): every id that a gold field or the relevance map of a task names."""
    there = [F.coalesce(F.col(f), F.array().cast("array<string>")) for f in BENCHMARK_ID_FIELDS if f in tasks.columns]
    if "relevance" in tasks.columns:
        there.append(F.coalesce(F.map_keys("relevance"), F.array().cast("array<string>")))
    return tasks.select(F.explode(F.concat(*there)).alias("skill_id")).where("skill_id is not null and skill_id <> ''").distinct()


def allocate(populations: dict[str, int], size: int) -> dict[str, int]:
    """How many of each stratum: one each if that is affordable, the rest in proportion to the roots of the populations."""
    names = sorted(k for k, n in populations.items() if n > 0)
    given = dict.fromkeys(populations, 0)
    left = size
    if left >= len(names):
        given |= dict.fromkeys(names, 1)
        left -= len(names)
    while left > 0:
        open_ = [k for k in names if given[k] < populations[k]]
        if not open_:
            raise ValueError("the sample is larger than the population")
        total = math.fsum(math.sqrt(populations[k]) for k in open_)
        share = {k: left * math.sqrt(populations[k]) / total for k in open_}
        whole = {k: min(math.floor(share[k]), populations[k] - given[k]) for k in open_}
        if any(whole.values()):
            for k, n in whole.items():
                given[k] += n
            left -= sum(whole.values())
        else:
            for k in sorted(open_, key=lambda k: (math.floor(share[k]) - share[k], k))[:left]:
                given[k] += 1
            left = 0
    return given


def eligible(skills: DataFrame, excluded: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows that may be sampled with ``stratum``, one row of counts): first in pool order of equal content."""
    rows = skills.where(F.length(text.strip(text.coerce("skill_id"))) > 0)
    marked = rows.join(excluded.select("skill_id").distinct().withColumn("out", F.lit(True)), "skill_id", "left") if excluded is not None else rows.withColumn("out", F.lit(None).cast("boolean"))
    some_text = F.length(text.strip(F.concat_ws("", "name", "description", "body"))) > 0
    hashed = marked.withColumn("hash", hashing.content_hash("name", "description", "body"))
    ranked = hashed.withColumn("nth", F.when(F.col("out").isNull() & some_text, F.row_number().over(Window.partitionBy("hash", F.col("out").isNull() & some_text).orderBy("pool_idx"))))
    counts = ranked.agg(F.count(F.when(F.col("out"), 1)).alias("excluded"), F.count(F.when(F.col("nth") > 1, 1)).alias("duplicates"))
    kept = ranked.where("nth = 1").drop("out", "hash", "nth").withColumn("stratum", F.concat_ws("::", text.category("category", "skill_id"), text.language_group("language", "name", "description", "body")))
    return kept, counts


def stratified_sample(skills: DataFrame, size: int, seed: int = 42, excluded: DataFrame | None = None) -> Sample:
    """``size`` rows, spread over strata of category and language. Only the strata's counts reach the driver."""
    if size <= 0:
        raise ValueError("sample size must be positive")
    rows, counts = eligible(skills, excluded)
    populations = {r.stratum: r.n for r in rows.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    if size > sum(populations.values()):
        raise ValueError(f"sample size {size} exceeds the {sum(populations.values())} eligible rows")
    given = allocate(populations, size)
    strata = skills.sparkSession.createDataFrame([(k, populations[k], given[k]) for k in sorted(populations)], "stratum string, population long, selected long")
    order = Window.partitionBy("stratum").orderBy("key", "skill_id")
    keyed = rows.withColumn("key", hashing.order_key(seed, F.col("stratum"), F.col("skill_id")))
    near = _under_threshold(keyed, strata)
    chosen = near.withColumn("nth", F.row_number().over(order)).where("nth <= selected").drop("nth", "selected", "key")
    position = F.row_number().over(Window.orderBy(hashing.order_key(seed, F.col("skill_id")), "skill_id"))
    return Sample(chosen.withColumn("position", position), strata, counts)


def _under_threshold(keyed: DataFrame, strata: DataFrame) -> DataFrame:
    """Of each stratum, rows that hold its ``selected`` smallest keys, and few others, with ``selected``.

    Keys are digests, so a share of them lies under the same share of their range. A stratum that is short of rows under its
    threshold (six standard deviations above what it needs) is taken whole.
    """
    wanted = (F.col("selected") + 6 * F.sqrt(F.col("selected").cast("double")) + 20) / F.col("population")
    limits = strata.select("stratum", "selected", F.lpad(F.hex(F.floor(F.least(wanted, F.lit(1.0)) * 0xFFFFFFFF).cast("long")), 8, "0").alias("limit"))
    near = cut(keyed.join(F.broadcast(limits), "stratum").where(F.substring("key", 1, 8) <= F.lower("limit")).drop("limit"))
    held = near.groupBy("stratum").agg(F.count("*").alias("held"))
    short = strata.join(held, "stratum", "left").where(F.coalesce("held", F.lit(0)) < F.col("selected")).select("stratum", "selected")
    if short.isEmpty():
        return near
    whole = keyed.join(F.broadcast(short), "stratum")
    return near.join(F.broadcast(short.select("stratum")), "stratum", "left_anti").unionByName(whole.select(near.columns))


def pilot_counts(populations: dict[str, int], limit: int) -> dict[str, int]:
    """Shares of ``limit`` in proportion, at least one of each type."""
    total = sum(populations.values())
    given = {k: max(1, limit * n // total) for k, n in populations.items()}
    by_rest = sorted(populations, key=lambda k: (-(limit * populations[k] % total), k))
    while sum(given.values()) < limit and any(given[k] < populations[k] for k in by_rest):
        for k in by_rest:
            if sum(given.values()) < limit and given[k] < populations[k]:
                given[k] += 1
    while sum(given.values()) > limit:
        given[max(given, key=lambda k: (given[k], k))] -= 1
    return given


def pilot(candidates: DataFrame, limit: int | None, kind: str = "candidate_type", order: str = "candidate_idx") -> DataFrame:
    """An even selection: of each type, evenly spaced rows in order; the first rows if ``limit`` is under the types' number."""
    if limit is None:
        return candidates
    populations = {r[0]: r[1] for r in candidates.groupBy(kind).count().collect()}
    if limit >= sum(populations.values()):
        return candidates
    if limit < len(populations):
        return candidates.orderBy(order).limit(limit)
    given = pilot_counts(populations, limit)
    picks = [(k, n * (populations[k] - 1) // (given[k] - 1) if given[k] > 1 else 0) for k in given for n in range(given[k])]
    wanted = candidates.sparkSession.createDataFrame(picks, f"{kind} string, place long")
    placed = candidates.withColumn("place", (F.row_number().over(Window.partitionBy(kind).orderBy(order)) - 1).cast("long"))
    return placed.join(F.broadcast(wanted), [kind, "place"]).drop("place")
