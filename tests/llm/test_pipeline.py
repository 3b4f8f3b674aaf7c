import corpus_pipeline
from tests.llm.test_operators import brute_components

from tessella.llm.jaccard_join import Rule

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r.text for r in out.collect()}
        assert set(rows) <= set(before)
        if name == "language_id":
            assert set(rows) == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        if name == "exact_duplicates":
            last = {}
            for i in sorted(before):
                last["".join(c.lower() if "A" <= c <= "Z" else c for c in before[i])] = i
            assert set(rows) == set(last.values())
        if name == "near_duplicates":
            assert set(rows) == {i for i, _, c in brute_components(list(before.items()), Rule(5, 80, 100)) if i == c}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not {i for i in rows if any(x in rows[i] for x in items)} and len(rows) >= len(before) - 20
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
