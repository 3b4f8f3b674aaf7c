import pytest
from pyspark.sql import functions as F

from tessella.functions import fixed
from tessella.operators import bm25, contracts, dense, fusion, generation, graph, metrics, negatives, sampling, training
from tessella.plans import queries
from tessella.sources import jsonl
from tessella.streaming import incremental


def test_bm25_fills_up_in_pool_order(spark):
    pool = spark.createDataFrame([(0, "alpha"), (1, "beta"), (2, "gamma")], "pool_idx long, body string")
    asked = spark.createDataFrame([("q", "beta"), ("r", "nothing")], "query_id string, query string")
    got = {q: [r.pool_idx for r in sorted(rows, key=lambda r: r["rank"])] for q, rows in _by(bm25.topk(pool, "body", asked, "query", 5)).items()}
    assert got == {"q": [1, 0, 2], "r": [0, 1, 2]}


def _by(df, key="query_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_dense_topk_breaks_ties_by_place(spark):
    pool = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "pool_idx long, embedding array<float>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "query_id string, embedding array<float>")
    for block in (8192, 1):
        got = {q: [r.pool_idx for r in sorted(rows, key=lambda r: r["rank"])] for q, rows in _by(dense.semantic_topk(asked, pool, 2, block)).items()}
        assert got == {"a": [0, 1], "b": [2, 0]}


def test_zero_vectors_are_errors(spark):
    with pytest.raises(Exception, match="non-zero"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(dense.normalized(F.col("v"))).collect()


def test_fusion_counts_the_first_place_only(spark):
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 3)], "query_id string, skill_id string, rank int")
    b = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query_id string, skill_id string, rank int")
    rows = sorted(fusion.reciprocal_rank_fusion([a, b], 3).collect(), key=lambda r: r["rank"])
    assert [r.skill_id for r in rows] == ["b", "a", "c"]


def test_evaluation_skips_and_strata(spark):
    pool = spark.createDataFrame([("a",), ("b",)], "skill_id string")
    tasks = spark.createDataFrame([("t1", ["a", "z"], False), ("t2", ["b"], False), ("t3", ["z"], False), ("t4", ["a"], True), ("t5", ["a"], False)], "query_id string, gold array<string>, generic_only boolean")
    ranked = spark.createDataFrame([("t1", 1, "x"), ("t1", 2, "b"), ("t1", 3, "b"), ("t1", 4, "a"), ("t2", 1, "b")], "query_id string, rank int, skill_id string")
    found = metrics.evaluate(tasks, ranked, pool)
    assert found.skipped.first().asDict() == {"skipped_generic_only": 1, "skipped_no_gt_in_pool": 1, "skipped_missing_prediction": 1}
    rows = {r.query_id: r for r in found.details.collect()}
    assert rows["t1"].stratum == "multi" and rows["t1"].mrr_10 == 0.5 and rows["t1"].full_coverage_1 == 0 and rows["t1"].recall_10 == 1
    assert rows["t2"].hit_1 == 1 and rows["t2"].ndcg_10 == 1
    assert {r.stratum: r["count"] for r in found.summary.collect()} == {"all": 2, "single": 1, "multi": 1}


def test_identity_reasons_in_order(spark):
    body = "the quick brown fox jumps over the lazy dog"
    skills = spark.createDataFrame([("p", "Name One", body), ("n", "name-one", "x"), ("b", "", f" {body} "), ("o", "o", body + "!"), ("k", "k", "something else")], "skill_id string, name string, body string")
    pairs = skills.select(F.lit("q").alias("query_id"), F.lit("p").alias("positive_skill_id"), "skill_id")
    got = {r.skill_id: r.reason for r in negatives.flag_identity(pairs, skills, 0.75).collect()}
    assert got == {"p": "same_skill_id", "n": "same_normalized_name", "b": "same_body", "o": "high_body_trigram_overlap", "k": None}


def test_scan_keeps_the_prefix_up_to_the_target(spark):
    rows = spark.createDataFrame([("q", i, p) for i, p in enumerate([True, False, True, False, True])], "query_id string, position int, passes boolean")
    assert sorted(r.position for r in negatives.scan(rows, 2).collect()) == [0, 1, 2]


def _copies(spark):
    """Far more copies of the positive than head and prefix hold, and nine skills that differ, last by skill_id."""
    body = "the quick brown fox jumps over the lazy dog"
    rows = [(f"a{n:03}", f"copy {n}", body, "c", n) for n in range(400)] + [(f"z{n}", f"other {n}", f"{n} nothing of the kind {n * 7919}", "c" if n < 5 else "d", 400 + n) for n in range(9)]
    return spark.createDataFrame(rows, "skill_id string, name string, body string, category string, pool_idx long").withColumn("description", F.lit(""))


def test_quotas_are_filled_behind_many_copies(spark):
    skills = _copies(spark)
    asked = spark.createDataFrame([("q1", "quick brown fox", "a007"), ("q2", "lazy dog", "a399"), ("q3", "other", "z0")], "query_id string, query string, positive_skill_id string")
    mined = negatives.mine_local(asked, skills, head=4, prefix=4)
    assert negatives.unfilled(mined, asked).count() == 0
    rows = mined.negatives.collect()
    assert all(r.skill_id[0] == "z" for r in rows if r.query_id != "q3") and len({(r.query_id, r.skill_id) for r in rows}) == len(rows) == 18
    out = mined.filtered.groupBy("query_id", "skill_id").count()
    assert out.where("count > 1").count() == 0
    several = asked.where("query_id <> 'q3'").select("query_id", "query", F.array("positive_skill_id").alias("positives"))
    vectors = skills.select("skill_id", F.when(F.col("category") == "c", F.array(F.lit(1.0), (F.col("pool_idx") >= 400).cast("double"))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    none = spark.createDataFrame([], "query_id string, skill_id string, score double, position long")
    many = negatives.mine_multi(several, skills, none, vectors, false_negative=0.95, head=4, prefix=4)
    assert {(r.query_id, r.source): r["count"] for r in many.negatives.groupBy("query_id", "source").count().collect()} == {(q, s): n for q in ("q1", "q2") for s, n in negatives.LOCAL_SOURCES}


def test_semantic_negatives_of_every_twentieth_vector(spark):
    import numpy as np

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = [r.vec_id for r in rows]
    want = set()
    for n, key in enumerate(ids):
        if key % 20 == 0:
            scores = m @ m[n]
            order = sorted(range(len(ids)), key=lambda x: (-round(scores[x], 6), x))[:50]
            local = [(x, ("bm25", "same_category", "random")[(p % 3)]) for p, x in enumerate(order, 1) if p % 5 == 0]
            taken = {}
            for source, quota in negatives.MERGED_SOURCES:
                found = [x for x in order if x != n and x not in taken] if source == "semantic" else [x for x, s in local if s == source and x != n and x not in taken]
                taken |= dict.fromkeys(found[:quota], source)
            want |= {(f"q{key}", f"v{ids[x]}", "embedding_false_negative" if round(scores[x], 6) >= 0.3 else s) for x, s in taken.items()}
    got = queries.QUERIES["semantic_negatives"](spark, sf).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {q for q, _, _ in want} == {f"q{k}" for k in ids if k % 20 == 0}


def test_multi_negatives_of_every_task(spark):
    import numpy as np

    sf = "/root/testdata/sf0.001"
    pool = queries.roles.pool(spark, sf).collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    vectors = {k: v / np.linalg.norm(v) for k, v in vectors.items()}
    pool = {r.pool_idx: r.skill_id for r in pool if r.pool_idx in vectors}
    asked = {r.query_id: r.item_id for r in queries.roles.tasks(spark, sf).collect()}
    positives = {q: sorted(s for i, s in pool.items() if i % 20 == n % 20)[:2] for q, n in asked.items()}
    at = {s: i for i, s in pool.items()}
    pairs = spark.createDataFrame([(q, p, s) for q in asked for p in positives[q] for s in at], "query_id string, positive_skill_id string, skill_id string")
    same = {(r.query_id, r.skill_id) for r in negatives.flag_identity(pairs, queries.roles.pool(spark, sf)).where("reason is not null").collect()}
    want = set()
    for q, n in asked.items():
        order = sorted(pool, key=lambda i: (-round(float(vectors[i] @ vectors[n]), 6), i))[:64]
        near = lambda i: any(round(float(vectors[i] @ vectors[at[p]]), 6) >= 0.35 for p in positives[q])  # noqa: E731, B023
        fits = [pool[i] for i in order if pool[i] not in positives[q] and (q, pool[i]) not in same and not near(i)]
        want |= {(q, s) for s in fits[:4]}
    rows = queries.QUERIES["multi_negatives"](spark, sf).collect()
    assert {(r.query_id, r.skill_id) for r in rows if r.state == "semantic"} == want
    quotas = dict(negatives.MERGED_SOURCES)
    assert all(sum(r.query_id == q and r.state == s for r in rows) == k for q in asked for s, k in quotas.items())


def test_fuzzy_duplicates_judge_every_sentence(spark, tmp_path):
    import re
    from itertools import zip_longest

    import __spark_entry__
    from tessella.functions import evidence as ev

    start = "The first sentence is of some length. " * 8
    rows = [(1, start + "It must be valid JSON."), (2, start + "Nothing else at all. More."), (3, "Other words begin here. " + start), (4, None), (5, "x" * 300), (6, "x" * 300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = {i: re.split(r"(?<=[.!?])\s+|\n+", t or "") for i, t in rows}
    want = {(i, n, ev.same_statement(a, b, False)) for i in range(1, 6) for n, (a, b) in enumerate(zip_longest(parts[i], parts[i + 1], fillvalue=""))}
    got = [tuple(r) for r in __spark_entry__.queries()["fuzzy_duplicates"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and {(1, 0, True), (1, 8, False), (5, 0, True)} <= want


def test_wide_prefixes_are_numbered_by_id(spark):
    skills = spark.range(9000).select(F.format_string("s%05d", F.pmod(F.col("id") * 7, F.lit(9000))).alias("skill_id"))
    got = negatives._first_ids(skills, 5000).collect()
    assert sorted((r.at, r.skill_id) for r in got) == [(n + 1, f"s{n:05}") for n in range(5000)]


def test_merge_lets_a_later_source_take_what_was_beyond_a_quota(spark):
    rows = [("q", "semantic", f"s{i}", 0.0, i) for i in range(6)] + [("q", "bm25", "s5", 0.0, 0), ("q", "bm25", "s0", 0.0, 1), ("q", "random", "r", 0.0, 0)]
    c = spark.createDataFrame(rows, "query_id string, source string, skill_id string, score double, position int")
    got = {(r.source, r.skill_id) for r in negatives.merge_sources(c, spark.createDataFrame([("q", "s1")], "query_id string, positive_skill_id string")).collect()}
    assert got == {("semantic", s) for s in ("s0", "s2", "s3", "s4")} | {("bm25", "s5"), ("random", "r")}


def test_false_negative_is_put_to_the_first_positive(spark):
    vectors = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.9, 0.1]), ("c", [1.0, 0.05]), ("d", [0.0, 1.0])], "skill_id string, embedding array<float>")
    cands = spark.createDataFrame([("q", "c", ["p2", "p1"]), ("q", "d", ["p2", "p1"])], "query_id string, skill_id string, positives array<string>")
    out = negatives.filter_false_negatives(cands, vectors, 0.95)
    assert [r.skill_id for r in out.kept.collect()] == ["d"] and [r.positive_skill_id for r in out.removed.collect()] == ["p2"]


def _contract(i, makes, needs, action, status="validated"):
    art = lambda x: [(x, "json", True)] if x else []
    return (i, 0, "h" + i, (status,), art(makes), art(needs), [], [(action,)])


def test_graph_joins_makers_to_users(spark):
    schema = "skill_id string, contract_idx long, source_hash string, extraction struct<status:string>, outputs array<struct<artifact:string,format:string,required:boolean>>, inputs array<struct<artifact:string,format:string,required:boolean>>, dependencies array<struct<name:string>>, operations array<struct<action:string>>"
    rows = [_contract("a", "normalized sales table", "", "generate"), _contract("b", "quarterly chart bundle", "normalized sales table", "validate"), _contract("c", "", "quarterly chart bundle", "review"), _contract("s", "x", "", "build", "failed"), _contract("m", "", "normalized sales", "sing")]
    asked = spark.createDataFrame([(r[0], r[2]) for r in rows], "positive_skill_id string, source_hash string")
    out = graph.build(spark.createDataFrame(rows, schema), asked, spark.createDataFrame([], "skill_id string"))
    assert sorted(r.skill_ids for r in out.pairs.collect()) == [["a", "b"], ["b", "c"]]
    assert [r.skill_ids for r in out.triples.collect()] == [["a", "b", "c"]]
    assert {(r.stage, *r.skill_ids, *r.reasons) for r in out.rejections.collect()} == {("eligibility", "s", "contract_not_validated"), ("pair_validation", "a", "m", "missing_complementary_operation")}
    with pytest.raises(ValueError):
        graph.Limits(max_pairs=0)


def test_allocation_and_pilot(spark):
    given = sampling.allocate({"a": 100, "b": 25, "c": 1}, 31)
    assert sum(given.values()) == 31 and given["c"] == 1 and given["a"] > given["b"]
    rows = spark.createDataFrame([(f"pair-{i}", "pair", i) for i in range(8)] + [("triple-0", "triple", 8), ("triple-1", "triple", 9)], "id string, candidate_type string, candidate_idx int")
    assert sorted(r.id for r in sampling.pilot(rows, 5).collect()) == ["pair-0", "pair-2", "pair-4", "pair-7", "triple-0"]


def test_losses(spark):
    rows = spark.createDataFrame([("q", 1.0, True), ("q", 0.0, False)], "query_id string, score double, positive boolean")
    assert training.listwise(rows).first().loss == pytest.approx(0.313262)
    assert training.info_nce(rows.withColumnRenamed("score", "similarity"), 1.0).first().loss == pytest.approx(0.313262)


def test_contract_round_trip():
    skill = {"skill_id": "s", "name": "n", "description": "d", "body": "Reads a table. Writes a chart. Must be small. Out of scope: video."}
    cite = lambda q: [{"source_field": "body", "quote": q}]
    semantic = {f: [] for f in contracts.COLLECTIONS} | {"source_languages": ["en"], "canonical_language": "en", "capability": {"summary": "x", "evidence_quotes": cite("Reads a table")}}
    semantic["constraints"] = [{"statement": "Must be small", "evidence_quotes": cite("Must be small")}]
    semantic["quality_criteria"] = [{"statement": "must be small", "evidence_quotes": cite("Must be small")}]
    semantic["exclusions"] = [{"statement": "video", "evidence_quotes": cite("Out of scope: video")}, {"statement": "x", "evidence_quotes": cite("Writes a chart")}]
    made = contracts.materialize(semantic, skill)
    assert contracts.check(made, skill) is None
    assert made["quality_criteria"] == [] and len(made["exclusions"]) == 1
    assert contracts.check(made | {"extra": 1}, skill) and contracts.check(made, skill | {"body": "other"})
    with pytest.raises(ValueError):
        contracts.materialize({k: v for k, v in semantic.items() if k != "inputs"}, skill)


def test_total_limit():
    given = contracts.share_out({"operations": 12, "inputs": 8, "outputs": 10, "preconditions": 8, "constraints": 12, "dependencies": 8, "exclusions": 8, "quality_criteria": 0})
    assert sum(given.values()) == fixed.CONTRACT_TOTAL


def test_payload_rules():
    c = {"candidate_id": "c", "candidate_type": "pair", "skill_ids": ["a1", "b1"], "edges": [{"from_skill_id": "a1", "to_skill_id": "b1"}]}
    good = {"query": " ".join(["word"] * 30), "positive_skill_ids": ["a1", "b1"], "subtasks": [{"step_id": "1", "skill_id": "a1", "instruction": "x"}, {"step_id": "2", "skill_id": "b1", "instruction": "y"}], "dependencies": [{"from_step_id": "1", "to_step_id": "2"}]}
    s = generation.Generation()
    assert generation.validate(c, {"a1": "h", "b1": "i"}, good, s, 1)["source_hashes"] == ["h", "i"]
    for change in ({"query": "short"}, {"query": "A1 " + good["query"]}, {"dependencies": []}, {"positive_skill_ids": ["b1", "a1"]}, {"subtasks": good["subtasks"][:1]}):
        with pytest.raises(ValueError):
            generation.validate(c, {"a1": "h", "b1": "i"}, good | change, s, 1)


def test_jsonl(spark, tmp_path):
    schema = spark.createDataFrame([], "a string, b long").schema
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "x.jsonl").write_text('{"a": "1", "b": 2}\n\n{"a": "ü"}\n')
    assert jsonl.read(spark, str(folder), schema).count() == 2
    out = str(tmp_path / "out")
    jsonl.write_atomic(spark.createDataFrame([("é", 1)], schema), out)
    assert [tuple(r) for r in jsonl.read(spark, out, schema).collect()] == [("é", 1)]
    with pytest.raises(FileExistsError):
        jsonl.write_atomic(spark.createDataFrame([("é", 1)], schema), out)
    (folder / "y.jsonl").write_text("nonsense\n")
    with pytest.raises(Exception, match="y.jsonl"):
        jsonl.read(spark, str(folder), schema).collect()
    assert jsonl.read_if_exists(spark, str(tmp_path / "none"), schema).count() == 0
    assert jsonl.update_manifest(spark, str(tmp_path / "m.json"), {"a": 1}) | jsonl.update_manifest(spark, str(tmp_path / "m.json"), {"b": 2}) == {"a": 1, "b": 2}


def test_stream_resumes(spark, tmp_path):
    folder = tmp_path / "in"
    rows = lambda ids: spark.createDataFrame([(i, "h", i) for i in ids], "skill_id string, source_hash string, prompt string")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def work(prompt, feedback):
        if prompt == "bad":
            raise ValueError("no")
        return prompt

    for ids in (["a", "b"], ["b", "c", "bad"]):
        rows(ids).write.mode("append").parquet(str(folder))
        incremental.run_stream(spark.readStream.schema(rows(["x"]).schema).parquet(str(folder)), work, out, state).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted(r.skill_id for r in got if r.response) == ["a", "b", "c"] and [r.attempts for r in got if r.error] == [3]
