import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import fim

TEXTS = [None, "", "a", "aé日😀" * 50, "plain ascii " * 400, "日本語" * 999, "has <P> inside", "ends with <", "<M", "P><S", "\0\n\t ", "x" * 300_000 + "é" * 100_000, "<", "S>", "é combining"]


def by_hand(doc_id, text, salt="1"):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    p, q = sorted((a % (n + 1), b % (n + 1)))
    x, y, z = text[:p], text[p:q], text[q:]
    if d % 100 < 20:
        return n, "spm", p, q - p, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", p, q - p, f"<P>{x}<S>{z}<M>{y}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i + 100 * k, t, "u", 1) for k in range(8) for i, t in enumerate(TEXTS)] + [(2, "a", "u", 1), (None, "no id at all", None, None), (-5, "negative", "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, h1 int").repartition(3)


def test_every_form_equals_a_plain_loop_and_comes_back(docs):
    got = fim.fill_in_middle(docs)
    rows = got.withColumn("back", fim.restored("output", "form")).collect()
    want = [(r.doc_id, *by_hand(r.doc_id, r.text)) for r in docs.collect()]
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == sorted(want, key=repr)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    originals = docs.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).collect()
    texts = {r.doc_id: r.text for r in originals}
    assert all(r.back == texts[r.doc_id] for r in rows)


def test_empty_table_and_other_names(docs):
    assert fim.fill_in_middle(docs.where("false")).count() == 0
    one = docs.where("doc_id = 3").select(F.col("doc_id").alias("key id"), F.col("text").alias("body"))
    assert fim.fill_in_middle(one, id_col="key id", text_col="body").first()["output"] == by_hand(3, TEXTS[3])[4]


def test_other_sentinels_and_shares(docs):
    forms = fim.Forms("[p]", "[s]", "[m]", fim_percent=100, spm_percent=100, salt="other")
    rows = fim.fill_in_middle(docs.where("length(text) > 0"), forms).withColumn("back", fim.restored("output", "form", forms)).collect()
    assert {r.form for r in rows} == {"spm"}
    assert all(r.output.startswith("[s]") and len(r.output) == r.n + 9 and len(r.back) == r.n for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é日😀\n"), max_size=30), min_size=1, max_size=6))
def test_runs_map_units_to_bytes_and_back(texts):
    data = "".join(texts).encode()
    runs = fim.Runs(np.frombuffer(data, np.uint8))
    places = np.cumsum([0] + [len(c.encode()) for c in "".join(texts)])
    assert runs.byte_at(np.arange(len(places))).tolist() == places.tolist()
    assert runs.unit_at(places).tolist() == list(range(len(places)))
    assert runs.total == len("".join(texts))


def test_long_batches_are_cut_into_slices(monkeypatch):
    monkeypatch.setattr(fim, "RUN_BYTES", 10)
    offsets = np.array([0, 4, 9, 30, 30, 35, 41])
    assert list(fim._slices(offsets)) == [(0, 2), (2, 3), (3, 5), (5, 6)]
