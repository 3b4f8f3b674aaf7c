import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import negatives, permutation


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 100, 1000])
def test_an_order_holds_every_number_once(spark, n):
    asked = spark.createDataFrame([(f"q{i}", n) for i in range(5)], "query_id string, n long")
    rows = permutation.order(asked, "n", negatives._whole(n), 42, F.col("query_id"), "random").collect()
    for q in range(5):
        mine = sorted((r.position, r.number) for r in rows if r.query_id == f"q{q}")
        assert sorted(x for _, x in mine) == list(range(n)) and len({p for p, _ in mine}) == n
    if n >= 16:
        assert len({tuple(x for _, x in sorted((r.position, r.number) for r in rows if r.query_id == f"q{q}")) for q in range(5)}) == 5


def test_a_wider_prefix_begins_with_a_narrower_and_a_rerun_is_equal(spark):
    asked = spark.createDataFrame([("a", 1000), ("none", 0)], "query_id string, n long")
    at = lambda w: sorted((r.position, r.number) for r in permutation.order(asked, "n", w, 1, F.col("query_id")).collect())
    assert at(200)[: len(at(50))] == at(50) and at(50) == at(50) and len(at(50)) >= 45


def test_every_number_is_as_likely_at_every_place(spark):
    """Chi-square over 4,000 orders of 20, at places 1 and 5."""
    asked = spark.range(4000).select(F.col("id").cast("string").alias("query_id"), F.lit(20).alias("n"))
    rows = permutation.order(asked, "n", 25, 9, F.col("query_id"))
    nth = F.row_number().over(permutation.Window.partitionBy("query_id").orderBy("position"))
    for place in (1, 5):
        seen = Counter(r.number for r in rows.withColumn("nth", nth).where(F.col("nth") == place).collect())
        chi = sum((seen[x] - 200) ** 2 / 200 for x in range(20))
        assert chi < 19 + 4 * math.sqrt(38), chi


def test_numbers_are_dense_in_all_and_in_each_group(spark):
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("skill_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("category"))
    out = permutation.numbered(rows.repartition(5), "skill_id", "category").collect()
    by_place = sorted(out, key=lambda r: (r.category, r.skill_id))
    assert [r.number for r in by_place] == list(range(3000))
    for group in {r.category for r in out}:
        assert [r.mate for r in by_place if r.category == group] == list(range(sum(r.category == group for r in out)))


def test_a_category_of_100_000_is_not_multiplied_by_its_queries(spark):
    """Twenty queries of one large category: quota-sized reads, results as of a loop over each query's own order."""
    pool = spark.range(100_000).select(F.col("id").alias("pool_idx"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("skill_id"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"), F.lit("").alias("description"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.lit("x")).alias("body"), F.lit("big").alias("category"))
    queries = spark.range(20).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("query"), F.concat(F.lit("s"), (F.col("id") * 7).cast("string")).alias("positive_skill_id"))
    lists = negatives._lists(queries, queries.select("query_id", "positive_skill_id"), pool, 42, 8, 16, negatives.text.plain_tokens)
    asked = queries.select("query_id")
    rows, whole = lists["same_category"](asked, 16)
    assert not whole and rows.count() <= 20 * 16
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    ids = sorted(f"s{i}" for i in range(100_000))
    a = math.isqrt(100_000 - 1) + 1
    b = -(-100_000 // a)

    def loop(q):
        import hashlib

        for i in range(16):
            left, right = divmod(i, b)
            for r in range(permutation.ROUNDS):
                drawn = int(hashlib.sha256(f"42:{q}:category:big:{r}:{right if r % 2 == 0 else left}".encode()).hexdigest()[:12], 16)
                left, right = ((left + drawn) % a, right) if r % 2 == 0 else (left, (right + drawn) % b)
            if left * b + right < 100_000:
                yield ids[left * b + right]

    got = {f"q{i}": [] for i in range(20)}
    for r in sorted(rows.collect(), key=lambda r: r.position):
        got[r.query_id].append(r.skill_id)
    assert got == {q: list(loop(q)) for q in got}
