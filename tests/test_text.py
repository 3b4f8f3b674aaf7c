import hashlib
import json
import random
import string

import pytest
from pyspark.sql import functions as F

from tessella.functions import evidence as ev
from tessella.functions import hashing, text


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return row.select(expr.alias("x")).first().x


def test_tokens_split_scripts_and_pair_cjk(spark):
    got = one(spark, text.tokens("t"), t="需要验证tables_v2 Öl-3.5 データ!x")
    assert got == ["需", "要", "验", "证", "需要", "要验", "验证", "tables", "v2", "öl", "3", "5", "デ", "ー", "タ", "デー", "ータ", "x"]
    assert one(spark, text.tokens("t"), t="") == []


def test_plain_tokens_equal_tokens_without_cjk(spark):
    t = "Straße ΣΊΣΥΦΟΣ don't 3.5 x²"
    assert one(spark, text.tokens("t"), t=t) == one(spark, text.plain_tokens("t"), t=t)


def test_trigrams_match_a_plain_version(spark):
    rng = random.Random(1)
    cases = ["", "  ", "ab", " A  b ", *("".join(rng.choice(string.ascii_letters + "  \n\tß") for _ in range(30)) for _ in range(20))]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", text.trigrams("t").alias("g")).collect()
    for r in rows:
        plain = " ".join(cases[r.i].casefold().split())
        want = set() if not plain else {plain} if len(plain) < 3 else {plain[i : i + 3] for i in range(len(plain) - 2)}
        assert set(r.g) == want and len(r.g) == len(want)


def test_jaccard_of_empty_sets_is_zero(spark):
    assert one(spark, text.jaccard(text.trigrams("a"), text.trigrams("b")), a="", b="") == 0
    assert one(spark, text.jaccard(text.trigrams("a"), text.trigrams("b")), a="abcd", b="abce") == pytest.approx(1 / 3)


@pytest.mark.parametrize(("category", "skill_id", "want"), [(" Web ", "x/1", "web"), ("", "Data/1", "data"), (None, "noslash", "other"), (None, "/x", "other")])
def test_category(spark, category, skill_id, want):
    assert one(spark, text.category("c", "s"), c=category, s=skill_id) == want


@pytest.mark.parametrize(("tag", "body", "want"), [("pt_BR", "x", "pt-br"), ("??", "テスト", "kana"), (None, "한글", "hangul"), (None, "汉字", "han"), (None, "Да", "cyrillic"), (None, "سلام", "arabic"), (None, "abc", "latin"), (None, "123", "und")])
def test_language_group(spark, tag, body, want):
    assert one(spark, text.language_group("l", "b"), l=tag, b=body) == want


def test_formats(spark):
    assert one(spark, text.format_skill("n", "d", "b"), n="n", d="d" * 400, b=None) == f"n | {'d' * 300} | "
    assert one(spark, text.rerank_prompt("q", "n", "d", "b", "flat-nd"), q="q", n="n", d="d", b="b").endswith("<Document>: n | d")
    with pytest.raises(ValueError):
        text.rerank_prompt("q", "n", "d", "b", "other")


def test_content_hash_is_that_of_compact_json(spark):
    want = hashlib.sha256(json.dumps({"body": "b\n", "description": "", "name": "é"}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, hashing.content_hash("n", "d", "b"), n="é", d=None, b="b\n") == want
    assert one(spark, hashing.stable_seed(42, "v").cast("string"), v="x") == str(int.from_bytes(hashlib.sha256(b"42:x").digest()[:8], "big"))


def test_alignment_of_quotes():
    source = {"name": "n", "description": "d", "body": "Use **bold\ntext** always here."}
    assert ev.align(source, "body", "always", "c") == ("body", "always", 18, ())
    found = ev.align(source, "name", "bold text always", "c")
    assert found.quote == "**bold\ntext** always" and source["body"][found.start :].startswith(found.quote) and len(found.warnings) == 2
    with pytest.raises(ValueError):
        ev.align(source, "body", "nowhere to be found", "c")


def test_labels_statements_and_fences():
    assert ev.reveals_label("run the PDF-tools skill", "pdf tools") and not ev.reveals_label("use pdf tools", "pdf tools")
    assert ev.same_statement("The file must be valid", "file is valid", False) and not ev.same_statement("", "x", False)
    assert ev.json_object('```\njson {"a": 1}\n```') == {"a": 1} and ev.json_object('```json\n{"a": 1}', strict_fence=False) == {"a": 1}
    assert ev.near_exclusion_heading("# Out of scope\n- a\n- b", 17) and not ev.near_exclusion_heading("# Scope\n- b", 9)
    with pytest.raises(ValueError):
        ev.json_object("[1]")


@pytest.mark.parametrize(
    "query, name, want",
    [
        ("the PDF Tools skill", "pdf-tools", True),
        ("use tool: pdf_tools now", "pdf tools", True),
        ("an agent called PDF tools", "pdf tools", True),
        ("source_skill named 'pdf tools'", "pdf tools", True),
        ("my_skill pdf tools", "pdf tools", False),
        ("pdf tools skills", "pdf tools", False),
        ("pdf tools_skill", "pdf tools", False),
        ("pdf and tools skill", "pdf tools", False),
        ("xpdf tools skill", "pdf tools", False),
        ("the skill label for pdf tools", "pdf tools", False),
        ("pdf pdf tools plugin", "pdf tools", True),
        ("skill ...", "", False),
        ("a b a b tool", "a b", True),
    ],
)
def test_labels_that_leak(query, name, want):
    assert ev.reveals_label(query, name) is want
