import random
import re

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash
from tessella.llm.common import StageTables
from tessella.llm.queries import op12_simhash


def by_hand(text, k=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius=2):
    """All pairs by brute force, in blocks."""
    a = np.array(sorted(fps), np.uint64)
    out = set()
    for i, x in enumerate(a):
        near = np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ x) <= radius) + i + 1
        out |= {(int(x), int(a[j])) for j in near}
    return out


def components(rows):
    """rows: (id, fingerprint); smallest id reachable."""
    parent = {f: f for _, f in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in linked(parent):
        parent[root(x)] = root(y)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f, least.get(root(f))) for i, f in rows]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


WORDS = [f"w{i}" for i in range(200)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    base = " ".join(rng.choices(WORDS, k=400))
    near = [" ".join(("Other" if rng.random() < 0.01 else w) for w in base.split()) for _ in range(60)]
    texts = [None, "", " \t\n", "one", "Two Words", "two\twords", "a b c d", "É é ß ſ", base, base.upper(), *near, *[" ".join(rng.choices(WORDS, k=30)) for _ in range(40)], "x y z " * 60_000]
    rows = [(i + 1, t, 1, "u") for i, t in enumerate(texts)] + [(i + 500, base, 1, "u") for i in range(100)] + [(None, base, 1, "u"), (None, "no id", 1, "u"), (4, "one", 1, "u")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int, rest string").repartition(3)


@pytest.mark.parametrize("most", [simhash.MOST_PAIRS, 0])
def test_components_equal_brute_force(docs, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_PAIRS", most)  # 0: every variant is cut down to windows of four bits
    want = components([(r.doc_id, by_hand(r.text)) for r in docs.collect()])
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("most", [simhash.MOST_PAIRS, 20])
def test_no_pair_of_a_dense_cluster_is_lost(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_PAIRS", most)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for centre in (0, rng.getrandbits(64), (1 << 64) - 1):
        for _ in range(250):  # balls around a centre, so that segments are equal for hundreds
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            fps.add(x)
    got = simhash.near_pairs(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), StageTables(spark, "test")).collect()
    pairs = [tuple(sorted((r.x % (1 << 64), r.y % (1 << 64)))) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == linked(fps)


def test_hot_fingerprints_are_joined_apart(docs, monkeypatch, spark):
    facts = spark.createDataFrame([(i, 7 if i < 1500 else i) for i in range(2000)], "doc_id long, fp long")
    named = facts.groupBy("fp").agg({"*": "count", "doc_id": "min"}).toDF("fp", "times", "component_id")
    out = simhash._joined(facts, named).collect()
    assert len(out) == 2000 and all(r.component_id == (0 if r.fp == 7 and r.doc_id < 1500 else min(r.doc_id, r.fp) if r.fp != 7 else 0) for r in out)


def test_query_equals_brute_force_on_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(i, f"{f:016x}", c) for i, f, c in components([(r.doc_id, by_hand(r.text)) for r in rows])]
    assert sorted(map(tuple, op12_simhash(spark, sf).collect())) == sorted(want)


def test_bits_are_counted_in_pieces(monkeypatch):
    h = simhash.shingle_hashes("a b c d e f g a b c", 3)
    want = simhash.fingerprint(h)
    monkeypatch.setattr(simhash, "_BITS_AT_ONCE", 3)
    assert simhash.fingerprint(h) == want == signed(by_hand("a b c d e f g a b c"))
