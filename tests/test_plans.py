import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import bm25
from tessella.plans import roles


def test_pairs_by_shared_grams_equal_a_product(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta gamma delta x y".split())
    bodies = [(f"s{i}", " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(150)] + [("none", None), ("odd", "  two  blanks alpha\nbeta ")]
    asked = []
    for i in range(60):
        words = bodies[rng.randrange(150)][1].split(" ")
        at, n = rng.randrange(max(1, len(words) - 3)), rng.randint(3, 9)
        text = " ".join(words[at : at + n])
        if text.count(" ") >= 2:
            asked.append((f"q{i}", text[1:] if i % 3 == 0 else text))
    skills = spark.createDataFrame(bodies, "skill_id string, body string").repartition(3)
    got = roles.holding(skills, spark.createDataFrame(asked, "query_id string, query string"))
    assert sorted((r.query_id, r.skill_id) for r in got.collect()) == sorted((q, s) for q, t in asked for s, b in bodies if b is not None and t in b)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    none = roles.holding(skills, spark.createDataFrame([], "query_id string, query string"))
    assert none.count() == 0
    with pytest.raises(Exception, match="two words or fewer: q"):
        roles.holding(skills, spark.createDataFrame([("q", "a b")], "query_id string, query string")).collect()


def test_salted_postings_give_the_same_scores(spark, monkeypatch):
    pool = spark.range(300).select(F.col("id").alias("pool_idx"), F.concat_ws(" ", F.lit("common"), (F.col("id") % 7).cast("string"), (F.col("id") % 50).cast("string"), F.when(F.col("id") % 3 == 0, "日本語")).alias("body"))
    queries = spark.createDataFrame([("a", "common 3 13"), ("b", "日本 common"), ("c", "")], "query_id string, query string")
    rank = lambda: sorted(map(tuple, bm25.rank(pool, "body", queries, "query", 20).collect()))
    want = rank()
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 0)
    assert rank() == want and {r[0] for r in want} == {"a", "b"}
