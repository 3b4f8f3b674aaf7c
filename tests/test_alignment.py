import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import alignment
from tessella.functions import evidence as ev


def test_projection_and_alignment_equal_the_plain_functions(spark):
    rng = random.Random(4)
    parts = ["word", "a", "*", "**", "`", " ", "  ", "\n", "\t*", "é", "日本", " ** ", "end.", "x*y", " ", "-"]
    make = lambda n: "".join(rng.choice(parts) for _ in range(n))
    rows = []
    for i in range(400):
        name, description, body = make(rng.randint(0, 5)), make(rng.randint(0, 30)), make(rng.randint(0, 80))
        text = rng.choice([name, description, body, body, body])
        a = rng.randint(0, max(0, len(text) - 1))
        quote = text[a : a + rng.randint(1, 40)]
        if rng.random() < 0.6:
            quote = rng.choice([lambda q: "**" + q + "`", lambda q: q.replace(" ", "  "), lambda q: q.replace("*", ""), lambda q: q.replace(" ", "\n* ")])(quote)
        if rng.random() < 0.1:
            quote = "not there at all"
        rows.append((i, name, description if rng.random() < 0.9 else None, body, rng.choice(ev.FIELDS), quote or "q"))
    df = spark.createDataFrame(rows, "i int, name string, description string, body string, field string, quote string").repartition(4)
    shown = {r.i: r.p for r in df.select("i", alignment.projected(F.coalesce("body", F.lit(""))).alias("p")).collect()}
    got = {r.i: r.a for r in df.select("i", alignment.align({f: F.col(f) for f in ev.FIELDS}, F.col("field"), F.col("quote"), "ctx").alias("a")).collect()}
    found = projected = moved = 0
    for i, name, description, body, field, quote in rows:
        assert shown[i] == ev.project(body)[0], body
        try:
            want = ev.align({"name": name, "description": description, "body": body}, field, quote, "ctx")
        except ValueError:
            assert got[i] is None, (rows[i], got[i])
            continue
        assert got[i] is not None, rows[i]
        assert (got[i].field, got[i].quote, got[i].start, tuple(got[i].warnings)) == tuple(want), rows[i]
        found += 1
        projected += any("markdown" in w for w in want.warnings)
        moved += any("corrected" in w for w in want.warnings)
    assert found > 200 and projected > 30 and moved > 30


@pytest.mark.parametrize("quote", ["", None])
def test_empty_quotes(spark, quote):
    row = spark.createDataFrame([("n", "d", "b", "body", quote)], "name string, description string, body string, field string, quote string")
    got = row.select(alignment.align({f: F.col(f) for f in ev.FIELDS}, F.col("field"), F.col("quote"), "c").alias("a")).first().a
    assert (got is None) == (quote is None)
