import pytest
from pyspark.sql import functions as F

from tessella.operators import guards


@pytest.fixture
def pool(spark):
    return spark.createDataFrame([(f"s{i}", f"name {i}") for i in range(50)], "skill_id string, name string").repartition(4)


def records(spark, *rows):
    return spark.createDataFrame(rows, "query_id string, positive_skill_ids array<string>")


def fails(df, text):
    for run in (df.collect, df.count, lambda: df.groupBy().agg(F.count("*")).collect()):
        with pytest.raises(Exception, match=text):
            run()


def test_clean_rows_pass(spark, pool):
    out = guards.positives(records(spark, ("q1", ["s3", "s1"]), ("q2", ["s3"])), pool).collect()
    assert sorted(map(tuple, out)) == [("s1", "q1", 1, "name 1"), ("s3", "q1", 0, "name 3"), ("s3", "q2", 0, "name 3")]
    assert guards.unique(pool, "skill_id").count() == 50


@pytest.mark.parametrize(("row", "text"), [
    (("", ["s1"]), "a record has no query_id"), ((None, ["s1"]), "a record has no query_id"), (("q9", []), "no positives: q9"), (("q9", None), "no positives: q9"),
    (("q9", ["s1", ""]), "an empty positive id: q9"), (("q9", ["s1", None]), "an empty positive id: q9"), (("q9", ["s1", "s2", "s1"]), "a positive id repeats: q9"), (("q9", ["s1", "nowhere"]), "not in the pool: nowhere"),
])
def test_a_bad_record_is_named(spark, pool, row, text):
    fails(guards.positives(records(spark, ("q1", ["s3"]), row), pool), text)


def test_a_repeated_id_is_named_however_often_it_comes(spark, pool):
    twice = pool.unionByName(pool.where("skill_id = 's7'"))
    fails(guards.unique(twice, "skill_id", "skill_id"), "skill_id is not unique: s7")
    fails(guards.positives(records(spark, ("q1", ["s3"])), twice), "skill_id is not unique: s7")
    hot = spark.range(20_000).select(F.lit("x").alias("skill_id"))
    fails(guards.unique(hot, "skill_id"), "id is not unique: x")


def test_a_pool_without_ids(spark, pool):
    with pytest.raises(ValueError, match="no valid skill_id"):
        guards.skills(pool.withColumn("skill_id", F.lit("")))
    assert guards.skills(pool.unionByName(pool.withColumn("skill_id", F.lit(None).cast("string")))).count() == 50


def test_the_guard_rides_on_the_joins_shuffle(spark, pool):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = spark.createDataFrame([("s1", 1)], "skill_id string, n int")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        exchanges = lambda df: plan(df).count("Exchange hashpartitioning")
        assert exchanges(other.join(guards.unique(pool, "skill_id"), "skill_id", "left")) == exchanges(other.join(pool, "skill_id", "left")) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
