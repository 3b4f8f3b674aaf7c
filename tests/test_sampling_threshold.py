import pytest
from pyspark.sql import functions as F

from tessella.functions import hashing
from tessella.operators import manifests, sampling


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(i, f"s{i}", f"name {i}", "", f"body {i % 900}", ("big" if i % 3 else f"c{i % 5}"), "en") for i in range(3000)]
    return spark.createDataFrame(rows, "pool_idx int, skill_id string, name string, description string, body string, category string, language string").repartition(4)


def by_hand(keyed, wanted):
    out = set()
    for stratum, n in wanted.items():
        mine = sorted((r.key, r.skill_id) for r in keyed if r.stratum == stratum)
        out |= {s for _, s in mine[:n]}
    return out


@pytest.mark.parametrize("size", [6, 40, 900, 2900])
def test_a_threshold_gives_what_a_full_order_gives(spark, pool, size):
    sample = sampling.stratified_sample(pool, size)
    rows, _ = sampling.eligible(pool, None)
    keyed = rows.withColumn("key", hashing.order_key(42, F.col("stratum"), F.col("skill_id"))).collect()
    wanted = {r.stratum: r.selected for r in sample.strata.collect()}
    assert {r.skill_id for r in sample.records.collect()} == by_hand(keyed, wanted)


def test_few_rows_lie_under_a_threshold_and_a_short_stratum_is_taken_whole(spark):
    keyed = spark.range(20_000).select(F.lit("a").alias("stratum"), F.col("id").cast("string").alias("skill_id"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    skewed = spark.range(500).select(F.lit("b").alias("stratum"), F.col("id").cast("string").alias("skill_id"), F.concat(F.lit("ff"), F.sha2(F.col("id").cast("string"), 256)).alias("key"))
    strata = spark.createDataFrame([("a", 20_000, 50), ("b", 500, 50)], "stratum string, population long, selected long")
    near = sampling._under_threshold(keyed.unionByName(skewed), strata)
    counts = {r.stratum: r["count"] for r in near.groupBy("stratum").count().collect()}
    assert 50 <= counts["a"] < 250 and counts["b"] == 500


def test_the_sampling_manifest(spark, pool):
    out = spark.createDataFrame([("s1",), ("s2",), ("s1",)], "skill_id string")
    sample = sampling.stratified_sample(pool, 40, 42, out)
    got = manifests.sampling_manifest(sample, 40, 42, pool, out)
    assert len(got["selected_skill_ids"]) == 40 and sum(got["stratum_selected"].values()) == 40 and got["excluded_count"] == 2
    assert sum(got["stratum_population"].values()) == 2998 and got["duplicate_count"] == 0
    assert got["pool_digest"] == manifests.sampling_manifest(sample, 40, 42, pool.repartition(7), out.distinct())["pool_digest"] and got["excluded_ids_digest"] != 0
