import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import report, rerank, retrieval
from tessella.sources import jsonl


@pytest.fixture(scope="module")
def ranking(spark):
    rows = [(f"q{q}", f"s{(q + r) % 9}", 1.0 / r, r) for q in range(6) for r in range(1, 8)]
    return spark.createDataFrame(rows, "query_id string, skill_id string, score double, rank int").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(f"q{q}", f"text {q}", f"s{q}" if q % 2 else None, [f"s{q + 1}", f"s{q}"] if q % 3 else None) for q in range(7)]
    return spark.createDataFrame(rows, "query_id string, query string, positive_skill_id string, positive_skill_ids array<string>")


def test_outputs_are_written_and_read_again(spark, ranking, queries, tmp_path):
    paths = [str(tmp_path / x) for x in ("predictions", "records")]
    out = retrieval.write_outputs(ranking, queries, *paths)
    assert (out["predictions"], out["queries"]) == (6, 7)
    again = retrieval.read_predictions(spark, paths[0])
    assert sorted(map(tuple, again.collect())) == sorted((r.query_id, r.skill_id, r.rank) for r in ranking.collect())
    lines = {r["query_id"]: r for r in (json.loads(x.value) for x in spark.read.text(paths[1]).collect())}
    assert lines["q1"]["positive_skill_ids"] == ["s1", "s2"] and lines["q1"]["positive_skill_id"] == "s1"
    assert lines["q3"]["positive_skill_ids"] == ["s3"] and lines["q0"]["positive_skill_ids"] == [] and "retrieved_candidates" not in lines["q6"]
    assert [c["rank"] for c in lines["q2"]["retrieved_candidates"]] == list(range(1, 8))
    with pytest.raises(FileExistsError):
        retrieval.write_outputs(ranking, queries, *paths)
    assert retrieval.write_outputs(ranking.where("query_id = 'q1'"), queries, *paths, overwrite=True)["predictions"] == 1


def test_a_score_is_written_with_details_and_rendered(spark, ranking, tmp_path):
    tasks = spark.createDataFrame([(f"q{q}", [f"s{q + 1}"] if q % 2 else [f"s{q + 1}", f"s{q + 2}"], q == 5) for q in range(6)] + [("q9", ["s1"], False), ("q8", ["nowhere"], False)], "query_id string, gold array<string>, generic_only boolean")
    pool = spark.createDataFrame([(f"s{i}",) for i in range(9)], "skill_id string")
    folders = [str(tmp_path / x) for x in ("good", "bad")]
    good = retrieval.write_score(tasks, ranking, pool, folders[0])
    worse = ranking.withColumn("rank", 8 - F.col("rank"))
    retrieval.write_score(tasks, worse, pool, folders[1], "reranker")
    assert (good["skipped_generic_only"], good["skipped_no_gt_in_pool"], good["skipped_missing_prediction"]) == (1, 1, 1)
    assert good["metrics"]["all"]["count"] == 5 and good["metrics"]["all"]["hit_1"] == 1.0 and good["metrics"]["multi"]["full_coverage_10"] == 1.0
    assert jsonl.read_json(spark, f"{folders[0]}/summary.json") == good
    assert spark.read.json(f"{folders[0]}/details").count() == 5
    systems = [report.System("First", "Retrieval", "retrieval", "good"), report.System("Second", "Rerank", "reranker", "bad")]
    text = report.write_table(spark, str(tmp_path), systems, "A title", str(tmp_path / "t.md"))
    assert (tmp_path / "t.md").read_text() == text and text.count("\n| ") == 4 and "Multi FullCoverage@10" in text
    first = next(x for x in text.splitlines() if x.startswith("| First"))
    assert first.count("|") == 10 and "**1.0000**" in first
    assert "**" not in report.write_table(spark, str(tmp_path), systems, "A title", str(tmp_path / "u.md"), bold_best=False)
    with pytest.raises(FileNotFoundError):
        report.load_summary(spark, folders[0], "reranker")
    with pytest.raises(ValueError, match="Hit@1"):
        report.values({"metrics": {}})


def test_reranking_by_an_injected_model(spark, ranking):
    rows = ranking.withColumn("prompt", F.concat_ws(" ", "query_id", "skill_id"))
    out = rerank.rerank(rows, lambda: lambda prompts: [float(ord(p[-1])) for p in prompts], top_k=5).collect()
    assert len(out) == 30 and all(r.reranker_score == ord(r.skill_id[-1]) for r in out)
    mine = sorted((r.reranker_rank, r.skill_id) for r in out if r.query_id == "q0")
    assert [s for _, s in mine] == ["s5", "s4", "s3", "s2", "s1"]
    vectors = ranking.limit(3).select(rerank.encode_column(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])("skill_id").alias("v")).collect()
    assert all(r.v == [2.0, 1.0] for r in vectors)
