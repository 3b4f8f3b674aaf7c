"""Text expressions: folding, tokens, n-grams, categories, languages and model input formats. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.fixed import QUERY_INSTRUCTION, RERANK_INSTRUCTION

#: CJK extension A and unified ideographs, hiragana and katakana, hangul syllables.
CJK = r"\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af"
WHITE = r"(?U)[\s\x1c-\x1f]+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(text: Column | str) -> Column:
    """Case folding: lower case plus the frequent letters that folding changes and lower-casing does not."""
    return F.replace(F.translate(F.lower(_col(text)), "ςſµ", "σsμ"), F.lit("ß"), F.lit("ss"))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")


def coerce(text: Column | str) -> Column:
    """Null is the empty string."""
    return F.coalesce(_col(text), F.lit(""))


def tokens(text: Column | str) -> Column:
    """Folded letter and digit runs; a CJK run gives each character and then each pair of neighbours."""
    runs = F.regexp_extract_all(fold(text), F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"), F.lit(0))

    def pieces(run: Column) -> Column:
        none = F.array().cast("array<string>")
        pairs = F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(none)
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(F.split(run, ""), pairs)).otherwise(F.array(run))

    # a text without CJK, as most are, takes one regular expression and no lambda
    return F.when(_col(text).rlike(f"[{CJK}]"), F.flatten(F.transform(runs, pieces))).otherwise(plain_tokens(text))


def plain_tokens(text: Column | str) -> Column:
    """``tokens`` for text known to hold no CJK."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normalized(text: Column | str) -> Column:
    return F.array_join(tokens(text), " ")


def trigrams(text: Column | str) -> Column:
    """The set of character trigrams of the folded text with single blanks; shorter texts are one gram, empty ones none."""
    t = strip(F.regexp_replace(fold(text), WHITE, " "))

    def grams(c: Column) -> Column:
        # the characters are split once and bound, so a gram costs the same wherever it lies
        none = F.array().cast("array<string>")
        many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
        return F.when(F.size(c) == 0, none).when(F.size(c) < 3, F.array(F.array_join(c, ""))).otherwise(many)

    characters = F.filter(F.split(t, ""), lambda x: x != "")
    return F.get(F.transform(F.array(characters), grams), F.lit(0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays without repeats; two empty ones give 0."""
    common = F.size(F.array_intersect(_col(a), _col(b)))
    union = F.size(_col(a)) + F.size(_col(b)) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(coerce(text), F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def category(value: Column | str, skill_id: Column | str) -> Column:
    """The given category, else the folded part of the id before its first slash, else ``other``."""
    own = strip(F.lower(_col(value)))
    prefix = F.when(_col(skill_id).contains("/"), strip(F.lower(F.split_part(_col(skill_id), F.lit("/"), F.lit(1)))))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(prefix, F.lit("")), F.lit("other"))


LANGUAGE_TAG = r"^[a-z]{2,3}(-[a-z0-9]+)*$"


def language_group(language: Column | str, *fields: Column | str) -> Column:
    """A well-formed explicit tag, else the script of the first 4000 characters of the fields."""
    tag = F.replace(F.lower(strip(_col(language))), F.lit("_"), F.lit("-"))
    text = F.substring(F.concat_ws(" ", *map(_col, fields)), 1, 4000)
    by_script = (
        F.when(text.rlike(r"[\u3040-\u30ff]"), "kana")
        .when(text.rlike(r"[\uac00-\ud7af]"), "hangul")
        .when(text.rlike(r"[\u4e00-\u9fff]"), "han")
        .when(text.rlike(r"[\u0400-\u04ff]"), "cyrillic")
        .when(text.rlike(r"[\u0600-\u06ff]"), "arabic")
        .when(text.rlike(r"[A-Za-z]"), "latin")
        .otherwise("und")
    )
    return F.when(tag.rlike(LANGUAGE_TAG), tag).otherwise(by_script)


def valid_languages(tags: Column | str) -> Column:
    """Non-empty, all well formed (or ``und``), none twice."""
    t = _col(tags)
    return (F.size(t) > 0) & F.forall(t, lambda x: F.coalesce(x.rlike(r"^(und|[a-z]{2,3})(-[A-Za-z0-9]{2,8})*$"), F.lit(False))) & (F.size(F.array_distinct(t)) == F.size(t))


def search_text(name: Column | str, description: Column | str, body: Column | str) -> Column:
    return F.concat_ws("\n", coerce(name), coerce(description), coerce(body))


def format_query(query: Column | str, max_chars: int = 1500) -> Column:
    return F.concat(F.lit(QUERY_INSTRUCTION), F.substring(_col(query), 1, max_chars))


def format_skill(name: Column | str, description: Column | str, body: Column | str, description_chars: int = 300, body_chars: int = 2500) -> Column:
    return F.concat_ws(" | ", coerce(name), F.substring(coerce(description), 1, description_chars), F.substring(coerce(body), 1, body_chars))


RERANK_FORMATS = ("flat-full", "flat-nd", "struct")


def rerank_prompt(query: Column | str, name: Column | str, description: Column | str, body: Column | str, form: str = "flat-full", description_chars: int = 500, body_chars: int = 2000) -> Column:
    if form not in RERANK_FORMATS:
        raise ValueError(f"unknown prompt format: {form}")
    n, d, b = coerce(name), F.substring(coerce(description), 1, description_chars), F.substring(coerce(body), 1, body_chars)
    head = F.concat(F.lit(f"<Instruct>: {RERANK_INSTRUCTION}\n\n<Query>: "), _col(query))
    if form == "struct":
        return F.concat(head, F.lit("\n\n<Skill>:\n<Name>: "), n, F.lit("\n<Description>: "), d, F.lit("\n<Body>: "), b)
    return F.concat(head, F.lit("\n\n<Document>: "), F.concat_ws(" | ", n, d, *([b] if form == "flat-full" else [])))


def reveals_id(query: Column | str, skill_ids: Column | str) -> Column:
    """Whether the folded query holds one of the folded ids."""
    q = fold(query)
    return F.exists(_col(skill_ids), lambda s: F.contains(q, fold(s)))
