import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import batching, manifests
from tessella.sources import jsonl

EXAMPLE = "query_id string, positive_skill_id string, negative_skill_ids array<string>, negative_sources array<string>, training_type string, loss_weight double"
ROWS = [(f"q{i}", f"s{i}", [f"n{j}" for j in range(i % 4)], [("bm25", "random")[j % 2] for j in range(i % 4)], ("single", "multi")[i % 3 == 0], 1.0 + (i % 3 == 0) / 2) for i in range(200)]


def examples(spark, rows=ROWS, parts=4):
    return spark.createDataFrame(rows, EXAMPLE).repartition(parts)


def test_the_manifest_equals_a_second_pass(spark, tmp_path):
    path = str(tmp_path / "x")
    got = manifests.write_training(examples(spark), path, ["single", "multi", "none"], ["bm25", "random", "semantic"], {"micro_batch_size": 4, "gradient_accumulation_steps": 8})
    written = jsonl.read(spark, path, spark.createDataFrame([], EXAMPLE).schema)
    by_type = {r.training_type: (r.n, r.mass) for r in written.groupBy("training_type").agg(F.count("*").alias("n"), F.sum("loss_weight").alias("mass")).collect()}
    sources = dict(map(tuple, written.select(F.explode("negative_sources").alias("s")).groupBy("s").count().collect()))
    assert got["training_types"] == {k: n for k, (n, _) in by_type.items()} and got["weighted_type_mass"] == {k: m for k, (_, m) in by_type.items()}
    assert got["negative_sources"] == sources and got["examples"] == 200 and got["mean_negatives"] == 1.5 and got["effective_query_batch_size"] == 32
    second = written.agg(manifests.training_measures(["single"], ["bm25"])["digest"].alias("d")).first().d
    assert got["digest"] == second


def test_a_digest_knows_rows_but_no_order(spark):
    d = lambda rows, parts=3: examples(spark, rows, parts).agg(manifests.digest("query_id", "loss_weight").alias("d")).first().d
    assert d(ROWS) == d(ROWS[::-1], 7) != d(ROWS[1:])
    assert d([]) == 0 and d(ROWS + ROWS[:1]) != d(ROWS)


@pytest.mark.parametrize(("change", "kind"), [({5: 0.0}, "weight"), ({4: "odd"}, "type"), ({3: ["web"]}, "source"), ({3: ["bm25"] * 9}, "lengths"), ({5: float("nan")}, "weight")])
def test_invalid_examples_leave_what_was_there(spark, tmp_path, change, kind):
    path = str(tmp_path / "x")
    write = lambda rows: manifests.write_training(examples(spark, rows), path, ["single", "multi"], ["bm25", "random"], overwrite=True)
    write(ROWS)
    bad = tuple(change.get(i, x) for i, x in enumerate(ROWS[1]))
    with pytest.raises(ValueError, match=kind):
        write([*ROWS, bad])
    assert jsonl.read(spark, path, spark.createDataFrame([], EXAMPLE).schema).count() == 200


def test_writers_at_once_lose_nothing(spark, tmp_path):
    folder, errors = str(tmp_path / "m"), []

    def write(i):
        try:
            for j in range(4):
                manifests.update_shared(spark, folder, {"stages": {f"w{i}": {f"s{j}": j}}, f"k{i}": j})
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert manifests.read_shared(spark, folder) == {"stages": {f"w{i}": {f"s{j}": j for j in range(4)} for i in range(5)}} | {f"k{i}": 3 for i in range(5)}
    assert manifests.read_shared(spark, str(tmp_path / "none")) == {}
    assert manifests.merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": {"e": 1}}, "d": {"x": 1}}) == {"a": {"b": {"e": 1}, "c": 2}, "d": {"x": 1}}


def test_scores_in_batches_equal_scores_one_by_one(spark):
    template = batching.Template((1, 2), (3,), 12)
    tokenize = lambda t: [ord(c) for c in t]
    seen = []

    def score(rows):
        seen.append((len(rows), max(map(len, rows))))
        assert all(r[:2] == [1, 2] and r[-1] == 3 and len(r) <= 12 for r in rows)
        return [sum(r) for r in rows]

    texts = ["x" * (i * 7 % 23) for i in range(100)]
    want = [float(sum(template.wrap(tokenize(t)))) for t in texts]
    assert batching.score_all(texts, tokenize, score, template, 40).tolist() == want
    assert all(n * longest <= 40 for n, longest in seen) and len(seen) < 40
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    column = batching.budget_scorer(lambda: (tokenize, lambda r: [sum(x) for x in r]), template, 40)("t")
    assert [r.s for r in rows.select("i", column.alias("s")).orderBy("i").collect()] == want
    assert [x.tolist() for x in batching.budgeted([100, 1], 10)] == [[0], [1]]
    for wrong in (lambda: batching.Template((1,), (2,), 2), lambda: list(batching.budgeted([1], 0))):
        with pytest.raises(ValueError):
            wrong()


def test_left_padding_puts_every_last_token_last():
    ids, mask = batching.left_padded([[5, 6], [], [7, 8, 9]], 0)
    assert ids.tolist() == [[0, 5, 6], [0, 0, 0], [7, 8, 9]] and mask.tolist() == [[0, 1, 1], [0, 0, 0], [1, 1, 1]]


def test_pooling_equals_a_loop(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(60):
        n = int(rng.integers(1, 9))
        states = rng.normal(size=(n, 4)).astype(np.float32)
        real = int(rng.integers(1, n + 1))
        mask = [1] * real + [0] * (n - real) if i % 2 else [0] * (n - real) + [1] * real
        rows.append((i, states.tolist(), mask))
    df = spark.createDataFrame(rows, "i int, states array<array<float>>, mask array<int>").repartition(3)
    got = df.select("i", batching.unit(batching.last_state("states", "mask")).alias("v")).orderBy("i").collect()
    for r, (_, states, mask) in zip(got, rows):
        v = np.array(states[max(j for j, m in enumerate(mask) if m)], np.float32).astype(float)
        assert np.allclose(r.v, v / np.linalg.norm(v), atol=1e-12)
    assert df.limit(1).select(batching.last_state("states", F.array(F.lit(0))).alias("v")).first().v is None
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]):
        with pytest.raises(Exception, match="no direction"):
            spark.createDataFrame([(bad,)], "v array<double>").select(batching.unit("v")).collect()
