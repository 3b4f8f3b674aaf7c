import itertools
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessella.streaming import inflight, keyed

ROWS = "stage string, skill_id string, source_hash string, ordinal long, prompt string"


def rows(spark, *given):
    """(skill_id, prompt): in order, one stage and hash."""
    return spark.createDataFrame([("query", s, "h", i, p) for i, (s, p) in enumerate(given)], ROWS)


def call(prompt, feedback):
    if prompt == "down":
        raise ConnectionError("no answer")
    if prompt == "learns":
        out = keyed.Answer("good" if feedback else "refused")
        out.finish_reason = "length"
        return out
    return prompt


def accept(row, answer):
    if answer == "refused":
        raise ValueError("not accepted")
    return f"{row['skill_id']}: {answer}"


WORKER = keyed.Worker(call, accept)
GIVEN = [("a", "x"), ("b", "down"), ("a", "later"), ("c", None), ("d", "learns"), ("e", "refused")]


def got(records):
    return sorted((r.skill_id, r.status, r.attempts, r.response, r.error_type, r.raw_response) for r in records.collect())


WANT = [("a", "result", 1, "a: x", None, None), ("b", "failure", 3, None, "ConnectionError", None), ("c", "failure", 0, None, "ValueError", None), ("d", "result", 2, "d: good", None, None), ("e", "failure", 3, None, "ValueError", "refused")]


def test_a_batch_tries_each_key_once(spark):
    given = rows(spark, *GIVEN)
    out = keyed.run_batch(given, given.where("false"), WORKER, keyed.Config(width=2), total=4)
    assert got(out) == WANT
    assert keyed.counts(given, out).first()[:] == (5, 2, 1, 3)
    again = keyed.run_batch(given, keyed.results(out), WORKER)
    assert {r.skill_id for r in again.collect()} == {"b", "c", "e"}
    assert keyed.run_batch(given.where("false"), given, WORKER).count() == 0


def test_contracts_are_found_by_id_and_hash(spark):
    skills = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "skill_id string, source_hash string")
    contracts = spark.createDataFrame([("a", "h1", "x"), ("b", "old", "y"), ("a", "h1", "x")], "skill_id string, source_hash string, contract string")
    assert sorted(map(tuple, keyed.with_contracts(skills, contracts).collect())) == [("a", "h1", "x"), ("b", "h2", None), ("c", "h3", None)]


def test_failures_are_pruned_by_stage_and_key(spark):
    records = spark.createDataFrame([("query", "a", "h", "failure", 3), ("query", "a", "h", "result", 4), ("contract", "a", "h", "failure", 3), ("query", "a", "h2", "failure", 0), ("query", "a", "h2", "failure", 3)], "stage string, skill_id string, source_hash string, status string, attempts int")
    full = records.selectExpr("*", "'' response", "'E' error_type", "'e' error", "'' raw_response", "'' finish_reason")
    assert sorted((r.stage, r.source_hash, r.attempts) for r in keyed.failures(full).collect()) == [("contract", "h", 3), ("query", "h2", 3)]


def test_a_stream_keeps_its_keys_over_a_restart(spark, tmp_path):
    """Stopped by an error in the middle of its second batch, it goes on and gives each key once."""
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]
    broken = tmp_path / "broken"

    def once(prompt, feedback):
        if broken.exists() and prompt == "stop":
            raise SystemExit("the worker is gone")
        return call(prompt, feedback)

    def start():
        source = spark.readStream.schema(ROWS).parquet(paths[0])
        keyed.run_stream(source, keyed.Worker(once, accept), *paths[1:], keyed.Config(width=2, buckets=4)).awaitTermination()

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        with keyed.state_store(spark):
            rows(spark, *GIVEN).coalesce(1).write.mode("append").parquet(paths[0])
            start()
            first = got(spark.read.parquet(paths[1]))
            assert first == WANT
            rows(spark, ("a", "again"), ("b", "y"), ("c", None), ("f", "stop"), ("g", "z")).coalesce(1).write.mode("append").parquet(paths[0])
            broken.write_text("x")
            with pytest.raises(Exception):
                start()
            assert got(spark.read.parquet(paths[1])) == first
            broken.unlink()
            start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    records = spark.read.parquet(paths[1])
    new = [("b", "result", 4, "b: y", None, None), ("c", "failure", 0, None, "ValueError", None), ("f", "result", 1, "f: stop", None, None), ("g", "result", 1, "g: z", None, None)]
    assert got(records) == sorted([*WANT, *new], key=lambda r: tuple(map(str, r[:3])))
    assert sorted(r.skill_id for r in keyed.results(records).collect()) == ["a", "b", "d", "f", "g"]
    assert sorted((r.skill_id, r.attempts) for r in keyed.failures(records).collect()) == [("c", 0), ("e", 3)]


def test_calls_stay_in_order_and_within_the_window():
    lock, running, most, taken = threading.Lock(), [0], [0], [0]

    def slow(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.002 * ((i * 7) % 5))
        with lock:
            running[0] -= 1
        if i % 10 == 3:
            raise KeyError(i)
        return i * i

    def items():
        for i in range(60):
            taken[0] += 1
            yield i

    out = []
    for n, (item, result, error) in enumerate(inflight.in_order(slow, items(), 4)):
        assert taken[0] <= n + 5  # no more is taken than may run
        out.append((item, result, type(error).__name__))
    assert out == [(i, None, "KeyError") if i % 10 == 3 else (i, i * i, "NoneType") for i in range(60)]
    assert 2 <= most[0] <= 4
    endless = inflight.in_order(lambda x: x, itertools.count(), 3)
    assert [x for x, _, _ in itertools.islice(endless, 5)] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        next(inflight.in_order(slow, [], 0))


def test_a_cluster_wide_limit_bounds_the_tasks(spark):
    assert inflight.limited(spark.range(1000), 20, 6).rdd.getNumPartitions() == 3
    assert inflight.limited(spark.range(1000), 20, 6, F.col("id")).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        inflight.limited(spark.range(3), 4, 5)
