"""Tier one of the token counts, and what the second and third order of the Jaccard join let through."""

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessella.llm import jaccard_join, token_counts

PATH = P.path("byte_bpe_50k.json")


def test_the_table_holds_frequent_pre_tokens_of_any_length():
    sample = ["Donaudampfschiffe fahren schnell. Donaudampfschiffe fahren langsam."] * 3
    keys = token_counts.frequent_pre_tokens(PATH, sample, 1000)
    sizes = dict(zip(keys, token_counts.Lengths(PATH).of(keys)))
    assert len(keys) == 1000 and keys[0] == "fahren" and sizes["\rDonaudampfschiffe"] > 3 and sizes["schnell."] >= 2


def test_counts_do_not_depend_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = [sorted(map(tuple, token_counts.count_tokens(docs, PATH, n).collect())) for n in (1, 65_536)]
    library = token_counts.Lengths(PATH).library
    want = sorted((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert counts[0] == counts[1] == want


def test_tier_one_answers_most_lookups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total, first = token_counts.count_tokens(docs, PATH, with_tiers=True).agg(F.sum("n_lookups"), F.sum("n_first")).first()
    assert first / total > 0.8, (first, total)


@pytest.mark.parametrize("n", [2500, 20_000])
def test_disjoint_large_sets_fail_the_second_and_third_order(spark, n):
    rng = np.random.default_rng(n)
    marks, rule = np.zeros(1 << (jaccard_join.MARK_BITS - 6), np.uint64), jaccard_join.Rule()
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(40)]
    prefix = lambda s, key: jaccard_join.ordered(s, marks, rule.prefix(len(s)), key).astype(np.uint32).view(np.int32).tolist()
    rows = [(i, prefix(s, jaccard_join._B), prefix(s, jaccard_join._C)) for i, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "id int, b array<int>, c array<int>")
    pairs = held.toDF("x", "bx", "cx").join(held.toDF("y", "by", "cy"), F.col("x") < F.col("y"))
    assert jaccard_join.agreeing(pairs).count() <= 7  # 1 % of 780


def test_linked_sets_pass_both_orders(spark):
    rng = np.random.default_rng(1)
    marks, rule = np.zeros(1 << (jaccard_join.MARK_BITS - 6), np.uint64), jaccard_join.Rule()
    for n in (5, 60, 3000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        t = np.unique(np.concatenate([s[: -max(1, n // 10)], rng.integers(0, 1 << 63, max(1, n // 12), dtype=np.uint64)]))
        if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t)):
            for key in (jaccard_join._B, jaccard_join._C):
                x, y = (set(jaccard_join.ordered(v, marks, rule.prefix(len(v)), key).astype(np.uint32).tolist()) for v in (s, t))
                assert x & y


def test_a_pair_meets_under_few_of_its_shared_tokens(spark):
    rule = jaccard_join.Rule(k=5, num=80, den=100)
    # two sets that share 90 tokens of their prefix, and a third that shares only the later ones with the first
    rows = [(t, s, 500, t + shift, 0, 0, 0, 0, s) for s, shift, tokens in ((1, 0, range(90)), (2, 1, range(90)), (3, 0, range(40, 90))) for t in tokens]
    postings = spark.createDataFrame(rows, "token long, set long, n int, at int, s0 long, s1 long, s2 long, s3 long, label long")
    apart = postings.groupBy("token").agg(F.count("*").alias("times"))
    left, right = jaccard_join._all_apart(jaccard_join._with_first(postings, postings.drop("label")), apart, jaccard_join._hot(apart), rule)
    found = [(r["set"], r.other) for r in jaccard_join._candidates(left, right, rule, True).select("set", "other").collect()]
    assert found.count((2, 1)) == 1
    assert {tuple(x) for x in found} == {(2, 1), (3, 1), (3, 2)}


def test_the_last_round_alone_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOT_TURNS", 0)
    monkeypatch.setattr(jaccard_join, "FIRST_TOKENS", 3)
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        words = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(60, 160)))]
        for _ in range(6):
            changed = list(words)
            for at in rng.integers(len(words), size=int(rng.integers(0, 5))):
                changed[at] = f"v{rng.integers(400)}"
            texts.append(" ".join(changed))
    rule = jaccard_join.Rule(k=3, num=70, den=100)
    sets = [set(jaccard_join.shingles(t, 3).tolist()) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        want = [min(want[j] for j in range(len(texts)) if 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_components(docs, rule).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < len(texts)
