"""Licence scan by a positional index of rare template words, with DataFrame functions only and no shuffle.

Templates are word sequences with a label. The index (built on the driver from the templates alone) gives every template
its ``LOOKUPS`` words of highest inverse document frequency among templates, with their positions. In each text the
positions of these words are looked up; a position less the word's place in the template is a possible start, and the
starts that all looked-up words of a template agree on are kept (posting lists intersected by relative position). A start
is a place of the template when its mandatory key phrases stand word for word at their own places, and as many of the
template's words stand at theirs as ``coverage`` asks for (base phrases: all). So nothing that fits is missed: the looked-up
words of a template are among its mandatory words.

Words are runs of digits, letters a-z and characters beyond ASCII after lower-casing A-Z. Null and empty texts have no
words and no place. Very long texts are scanned whole. The score is the best of a text's places, so ties don't matter. Repeated rows are
scanned each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import lower_ascii, two_columns

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOOKUPS = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases of the text that must stand at their places; the whole text for a base phrase.
    keys: tuple[str, ...]
    base: bool = False
    coverage: float = 0.8

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_places(self) -> list[tuple[int, list[str]]]:
        """(place in the text, words) of each mandatory phrase."""
        own = self.words
        return [(next(i for i in range(len(own)) if own[i : i + len(k)] == k), k) for k in (key.split() for key in self.keys)]


def phrase(text: str, label: str, base: bool = False) -> Template:
    return Template(label, text, (text,), base, 1.0)


# The base phrases and their labels.
BASE = (
    phrase("gnu general public license", "gpl", True),
    phrase("apache license", "apache", True),
    phrase("cc by", "cc-by", True),
    phrase("mit license", "mit", True),
)
# Sentences and names by which further licences are known.
FURTHER = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("you can redistribute it and or modify it",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    phrase("apache license version 2 0", "apache-2.0"),
    phrase("gnu general public license version 2", "gpl-2.0"),
    phrase("gnu general public license version 3", "gpl-3.0"),
    phrase("gnu lesser general public license", "lgpl"),
    phrase("gnu affero general public license", "agpl"),
    phrase("mozilla public license", "mpl"),
    phrase("eclipse public license", "epl"),
    phrase("boost software license", "bsl"),
    phrase("cc by sa", "cc-by-sa"),
    phrase("cc by nc", "cc-by-nc"),
    phrase("cc by nd", "cc-by-nd"),
)


def _places(words: Column, starts: Column, template: Template) -> Column:
    """The starts at which the template stands: array of (start, share of its words)."""
    own = template.words
    n = len(own)

    def fits(s: Column) -> Column:
        found = s >= 0
        for at, k in template.key_places():
            found = found & (F.slice(words, s + at + 1, len(k)) == F.array(*map(F.lit, k)))
        return found

    def share(s: Column) -> Column:
        if template.coverage >= 1:
            return F.lit(1.0)
        same = F.zip_with(F.slice(words, s + 1, n), F.array(*map(F.lit, own)), lambda a, b: F.when(a == b, 1).otherwise(0))
        return F.aggregate(same, F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0))) / float(n)

    placed = F.transform(F.filter(starts, fits), lambda s: F.struct(F.lit(template.label).alias("label"), F.lit(template.base).alias("base"), s.alias("start"), share(s).alias("share")))
    return F.filter(placed, lambda p: p["share"] >= template.coverage)


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + FURTHER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places): places is an array of (label, base, start, share)."""
    df = Counter(w for t in templates for w in set(t.words))
    lookups: list[list[tuple[str, int]]] = []
    for t in templates:
        # of the mandatory words, the rarest among templates; each at its first place in a mandatory phrase
        must: dict[str, int] = {}
        for at, k in t.key_places():
            for i, w in enumerate(k):
                must.setdefault(w, at + i)
        ranked = sorted((-math.log(len(templates) / df[w]), at, w) for w, at in must.items())
        lookups.append([(w, at) for _, at, w in ranked[:LOOKUPS]])
    rare = sorted({w for ls in lookups for w, _ in ls})
    rows = two_columns(docs, id_col, text_col)
    split = rows.select("doc_id", F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))
    seen = split.select("doc_id", "words", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(rare), i))).alias("at"))
    words = F.col("words")

    def starts(ls: list[tuple[str, int]]) -> Column:
        def each(w: str, p: int) -> Column:
            return F.transform(F.filter("at", lambda i: F.get(words, i) == w), lambda i: i - p)

        out, *rest = [each(w, p) for w, p in ls]
        for more in rest:
            out = F.array_intersect(out, more)
        return out

    places = F.flatten(F.array(*[_places(words, starts(ls), t) for t, ls in zip(templates, lookups)]))
    empty = F.array().cast("array<struct<label:string,base:boolean,start:int,share:double>>")
    return seen.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("at") > 0, places).otherwise(empty).alias("places"))


def digest(scanned: DataFrame) -> DataFrame:
    """One row a document with the numbers and labels of its places."""
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
