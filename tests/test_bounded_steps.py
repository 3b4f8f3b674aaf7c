"""Steps whose memory, shuffles or comparisons must not grow faster than what they read."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import bm25, dense, negatives, training
from tessella.plans import queries as plans
from tessella.plans import roles


def test_scratch_memory_of_dense_search_is_bounded_by_a_block():
    rng = np.random.default_rng(5)
    # coarse numbers, so that equal scores are frequent
    q, v = np.round(rng.normal(size=(4000, 8)), 1), np.round(rng.normal(size=(9000, 8)), 1)
    keys, k = [f"q{i}" for i in range(len(q))], 7
    index = rng.permutation(len(v))
    batches = [pa.RecordBatch.from_pydict({"pool_idx": pa.array(index[a : a + 5000]), "v": pa.array(list(v[a : a + 5000]))}) for a in range(0, len(v), 5000)]
    tracemalloc.start()
    out = list(dense._local_best(SimpleNamespace(value=(keys, q)), k)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    got = {}
    for b in out:
        for key, i, s in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(key, []).append((i, s))
    for n in range(0, len(q), 97):
        score = np.round(v @ q[n], 6)
        best = np.lexsort((index, -score))[:k]
        assert sorted(got[keys[n]]) == sorted((int(index[i]), float(score[i])) for i in best)


def test_fewer_rows_than_k_are_all_kept():
    q = np.eye(3)
    batch = pa.RecordBatch.from_pydict({"pool_idx": [5, 2], "v": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]})
    out = [r for b in dense._local_best(SimpleNamespace(value=(["a", "b", "c"], q)), 4)(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["query_id"], r["pool_idx"], r["score"]) for r in out) == [("a", 2, 0.0), ("a", 5, 1.0), ("b", 2, 1.0), ("b", 5, 0.0), ("c", 2, 0.0), ("c", 5, 0.0)]


def test_parts_of_scores_are_summed_where_documents_lie(spark):
    pool = spark.range(40).select(F.col("id").alias("pool_idx"), F.concat_ws(" ", F.lit("common"), (F.col("id") % 7).cast("string")).alias("body"))
    queries = spark.createDataFrame([("a", "common 3"), ("b", "common")], "query_id string, query string")
    plan = bm25.scores(pool, "body", queries, "query")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("hashpartitioning(pool_idx" in line for line in dealt)


def test_documents_without_text_count_as_documents(spark):
    pool = spark.createDataFrame([(0, "red"), (1, "blue"), (2, None)], "pool_idx long, body string")
    queries = spark.createDataFrame([("a", "red")], "query_id string, query string")
    (row,) = bm25.rank(pool, "body", queries, "query", 5).collect()
    assert (row.pool_idx, row.score) == (0, round(float(np.log(1 + 2.5 / 1.5)), 6))


def test_a_scan_reads_the_head_of_the_lexical_list_first(spark):
    pool = spark.range(300).select(F.col("id").alias("pool_idx"), F.format_string("x/%03d", "id").alias("skill_id"), F.lit("").alias("name"), F.lit("").alias("description"), F.concat(F.lit("common "), F.col("id").cast("string")).alias("body"), F.lit("x").alias("category"))
    queries = spark.createDataFrame([("a", "common 3", "x/003")], "query_id string, query string, positive_skill_id string")
    lists = negatives._lists(queries, queries.select("query_id", "positive_skill_id"), pool, 42, 100, 10, bm25.text.tokens)
    rows = {w: lists["bm25"](queries.select("query_id"), w) for w in (10, 80, 640)}
    ids = {w: [r.skill_id for r in df.orderBy("position").collect()] for w, (df, _) in rows.items()}
    assert [len(ids[w]) for w in rows] == [10, 80, 300] and [whole for _, whole in rows.values()] == [False, False, True]
    assert ids[80][:10] == ids[10] and ids[640][:80] == ids[80]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_ranking_that_is_read_twice_is_worked_out_once(spark):
    assert "Window" not in _plan(plans._bm25_rank(spark, "/root/testdata/sf0.001", 3))
    assert "MapInArrow" not in _plan(plans._evaluation(spark, "/root/testdata/sf0.001")[1].skipped)


def test_few_rows_go_to_the_texts(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        skills = spark.range(60).select(F.format_string("s%d", "id").alias("skill_id"), F.lit("n").alias("name"), F.lit("d").alias("description"), F.format_string("x one two %d three four y", F.col("id") % 5).alias("body"))
        asked = spark.createDataFrame([("q", "x one two 3 three four y")], "query_id string, query string")
        held = roles.holding(skills, asked)
        assert held.count() == 12 and "Exchange hashpartitioning" not in _plan(held)
        pairs = spark.createDataFrame([("q", "s1", "s6"), ("q", "s1", "s2")], "query_id string, positive_skill_id string, skill_id string")
        flagged = negatives.flag_identity(pairs, skills, 0.999)
        assert {r.skill_id: r.reason for r in flagged.collect()} == {"s6": "same_normalized_name", "s2": "same_normalized_name"}
        records = asked.withColumn("positive_skill_id", F.lit("s3")).withColumns({"positives": F.array(F.lit("s3")), "training_type": F.lit("single"), "loss_weight": F.lit(1.0)})
        listed = spark.createDataFrame([("q", "s8", "bm25", 1), ("q", "s3", "bm25", 2), ("q", "s4", "bm25", 3)], "query_id string, skill_id string, source string, position int")
        made = training.biencoder_examples(records, listed, skills)
        assert made.first().negative_skill_ids == ["s8", "s4"] and made.first().positive_text == "n | d | x one two 3 three four y"
        for plan in (_plan(flagged), _plan(made)):
            assert "BroadcastHashJoin [skill_id" in plan and "LeftSemi" in plan
        with pytest.raises(Exception, match="unknown skill"):
            training.biencoder_examples(records, listed.withColumn("skill_id", F.lit("none")), skills).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _sent(df, key):
    """(rows, rows that its shuffles by ``key`` have written)"""
    rows, todo, n = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if name == "Exchange" and f"hashpartitioning({key}#" in node.outputPartitioning().toString():
                n += node.metrics().get("shuffleRecordsWritten").get().value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, n


@pytest.mark.parametrize("most", [2000, 7])
def test_ranking_moves_no_whole_list_of_every_task(spark, monkeypatch, most):
    """40 tasks of 10 documents pass on 5 rows each to 10 queries, unless they know what the last places take; with few tasks, in passes."""
    monkeypatch.setattr(bm25, "TASK_PAIRS", 100)
    monkeypatch.setattr(bm25, "MAX_TASKS", most)
    monkeypatch.setattr(bm25, "SHARE", 4, raising=False)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    pool = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(20, 60))) if i % 7 else "w1 w2 w3 w4 w5 w6") for i in range(400)], "pool_idx long, body string")
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.sample(words, 6))) for i in range(9)] + [("few", "w1 none")], "query_id string, query string")
    whole = lambda d: sorted((r.query_id, r["rank"], r.pool_idx, r.score) for r in d)
    got, sent = _sent(bm25.rank(pool, "body", queries, "query", 5), "query_id")
    assert whole(got) == whole(bm25.ranked(bm25.scores(pool, "body", queries, "query"), 5).collect()) and len(got) == 50
    assert 50 <= sent < (600 if most > 40 else 350)
