"""Manifests of written data, gathered in the write itself, and manifests that several writers share.

Counts, sums and digests are observed metrics: they ride on the job that writes, and nothing is read again. A digest is the
sum over all rows of 60 bits of the MD5 of the row's text, modulo 2^53; so it depends on the rows but not on their order
or partitions.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessella.sources import jsonl

DIGEST_BASE = 1 << 53


def digest(*columns: Column | str) -> Column:
    """An order-free digest of the rows, as an aggregate; null differs from empty."""
    text = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\u0000")) for c in columns))
    value = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.coalesce((F.sum(value) % DIGEST_BASE).cast("long"), F.lit(0))


def _named(prefix: str, values: Iterable[str], measure) -> dict[str, Column]:
    return {f"{prefix}:{v}": measure(v) for v in values}


def training_measures(types: Iterable[str], sources: Iterable[str]) -> dict[str, Column]:
    """Aggregates over bi-encoder examples: by type and source, negatives, and what makes an example invalid."""
    types, sources = list(types), list(sources)
    kind, weight = F.coalesce("training_type", F.lit("single_skill")), F.coalesce("loss_weight", F.lit(1.0))
    listed = lambda v: F.size(F.filter("negative_sources", lambda x: x == v))
    known = F.size(F.filter("negative_sources", lambda x: x.isin(sources)))
    return {
        "examples": F.count(F.lit(1)),
        "negatives": F.coalesce(F.sum(F.size("negative_skill_ids").cast("long")), F.lit(0)),
        **_named("type", types, lambda t: F.count_if(kind == t)),
        **_named("mass", types, lambda t: F.coalesce(F.sum(F.when(kind == t, weight)), F.lit(0.0))),
        **_named("source", sources, lambda s: F.coalesce(F.sum(listed(s).cast("long")), F.lit(0))),
        "invalid:weight": F.count_if(~(weight > 0) | F.isnan(weight)),
        "invalid:type": F.count_if(~kind.isin(types)),
        "invalid:source": F.count_if(F.size("negative_sources") != known),
        "invalid:lengths": F.count_if(F.size("negative_sources") != F.size("negative_skill_ids")),
        "digest": digest("query_id", "positive_skill_id", F.to_json(F.struct("negative_skill_ids")), "training_type", "loss_weight"),
    }


def write_with_measures(rows: DataFrame, path: str, measures: dict[str, Column], overwrite: bool = False) -> dict:
    """Writes JSON lines to ``path`` as ``jsonl.write_atomic`` does; returns the measures of what was written."""
    seen, names = Observation(), list(measures)
    jsonl.write_atomic(rows.observe(seen, *(measures[n].alias(f"m{i}") for i, n in enumerate(names))), path, overwrite)
    return {n: seen.get[f"m{i}"] for i, n in enumerate(names)}


def write_training(examples: DataFrame, path: str, types: Iterable[str], sources: Iterable[str], settings: dict | None = None, overwrite: bool = False) -> dict:
    """Writes the examples and returns their manifest; an invalid example fails it, and what was there before is kept aside."""
    measures = training_measures(types, sources)
    found = write_with_measures(examples, f"{path}.new", measures, overwrite=True)
    fs, new = jsonl._fs(examples.sparkSession, f"{path}.new")
    invalid = {n.split(":")[1]: v for n, v in found.items() if n.startswith("invalid:") and v}
    if invalid:
        fs.delete(new, True)
        raise ValueError(f"invalid examples by kind: {invalid}")
    target = jsonl._fs(examples.sparkSession, path)[1]
    if fs.exists(target):
        if not overwrite:
            fs.delete(new, True)
            raise FileExistsError(path)
        aside = jsonl._fs(examples.sparkSession, path + jsonl.OLD)[1]
        fs.delete(aside, True)
        jsonl._rename(fs, target, aside)  # ``jsonl.restore`` finds it, should the next rename fail
        jsonl._rename(fs, new, target)
        fs.delete(aside, True)
    else:
        jsonl._rename(fs, new, target)
    return training_manifest(found, settings)


def training_manifest(found: dict, settings: dict | None = None) -> dict:
    part = lambda prefix: {n.split(":", 1)[1]: v for n, v in sorted(found.items()) if n.startswith(prefix + ":") and v}
    out = {"examples": found["examples"], "training_types": part("type"), "weighted_type_mass": part("mass"), "negative_sources": part("source"), "mean_negatives": found["negatives"] / found["examples"] if found["examples"] else 0.0, "digest": found["digest"]}
    settings = settings or {}
    if {"micro_batch_size", "gradient_accumulation_steps"} <= settings.keys():
        out["effective_query_batch_size"] = settings["micro_batch_size"] * settings["gradient_accumulation_steps"]
    return out | {"settings": settings}


def sampling_manifest(sample, size: int, seed: int, pool: DataFrame, excluded: DataFrame | None = None) -> dict:
    """What a stratified sample was drawn from and how: sizes by stratum, digests of pool and exclusions, the chosen ids.

    The chosen ids are ``size`` at most. Pool and exclusions are told by order-free digests.
    """
    strata = sample.strata.orderBy("stratum").collect()
    counts = sample.counts.first()
    none = excluded is None
    return {
        "sample_size": size, "seed": seed,
        "pool_digest": pool.agg(digest("skill_id", "name", "description", "body").alias("d")).first().d,
        "excluded_ids_digest": 0 if none else excluded.select("skill_id").distinct().agg(digest("skill_id").alias("d")).first().d,
        "selected_skill_ids": [r.skill_id for r in sample.records.orderBy("position").select("skill_id").collect()],
        "stratum_population": {r.stratum: r.population for r in strata}, "stratum_selected": {r.stratum: r.selected for r in strata},
        "excluded_count": counts.excluded, "duplicate_count": counts.duplicates,
    }


# ---- shared manifests -------------------------------------------------------------------------------------------------
_LOCK = threading.Lock()
KEPT_VERSIONS = 10


def merged(old: dict, new: dict) -> dict:
    """``old`` with ``new`` put in: dicts are merged at every depth, anything else is replaced."""
    out = dict(old)
    for k, v in new.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _versions(fs, folder) -> list[int]:
    return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v")) if fs.exists(folder) else []


def read_shared(spark: SparkSession, folder: str) -> dict:
    fs, at = jsonl._fs(spark, folder)
    there = _versions(fs, at)
    return _load(spark, fs, f"{folder}/v{there[-1]:09d}.json") if there else {}


def _load(spark: SparkSession, fs, path: str) -> dict:
    stream = fs.open(jsonl._fs(spark, path)[1])
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def update_shared(spark: SparkSession, folder: str, changes: dict, attempts: int = 50) -> dict:
    """Merges ``changes`` into the manifest in ``folder``; writers at the same time lose nothing.

    Every state is a file of its own, ``v000000001.json`` and so on. A writer merges into the last one and renames its file
    to the next number, which fails if another took it; then it starts again from that one. Renaming without
    overwriting is atomic in HDFS; writers of one process also take a lock.
    """
    jvm = spark._jvm
    fs, at = jsonl._fs(spark, folder)
    fs.mkdirs(at)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    for _ in range(attempts):
        there = _versions(fs, at)
        new = merged(_load(spark, fs, f"{folder}/v{there[-1]:09d}.json") if there else {}, changes)
        made = f"{folder}/.{uuid.uuid4().hex}"
        jsonl.write_json(spark, new, made)
        taken = f"{folder}/v{(there[-1] if there else 0) + 1:09d}.json"
        source, target = (jsonl._fs(spark, x)[1] for x in (made, taken))
        with _LOCK:
            try:
                context.rename(source, target, none)
            except Exception as e:  # noqa: BLE001
                fs.delete(source, False)
                if "FileAlreadyExists" not in str(e):
                    raise
                continue
        for old in there[: -KEPT_VERSIONS + 1]:
            fs.delete(jsonl._fs(spark, f"{folder}/v{old:09d}.json")[1], False)
        return new
    raise TimeoutError(f"{folder}: another writer was faster {attempts} times")
