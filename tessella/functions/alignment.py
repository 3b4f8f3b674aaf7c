"""Quotes found again in the texts they cite, as column expressions: word for word, else apart from markup and white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.evidence import FIELDS, MARKUP, MIN_PROJECTED

_SPACE = r"[\s\x1c-\x1f]"
#: A run of markup, white space with markup inside it, or one other character.
PIECES = rf"(?U)[*`]+|{_SPACE}(?:[*`]*{_SPACE})*|[^\s\x1c-\x1f*`]"


def projected(text: Column) -> Column:
    """The text without asterisks and backticks and with single blanks."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?U){_SPACE}(?:[*`]*{_SPACE})*", " "), "[*`]", "")


def _exact(raw: Column, quote: Column) -> Column:
    at = F.call_function("locate", quote, raw)
    return F.when(at > 0, F.struct(quote.alias("quote"), (at - 1).cast("long").alias("start")))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not wherever it is named."""
    return F.transform(F.array(value), use)[0]


def _by_projection(raw: Column, quote: Column) -> Column:
    """The raw span whose projection is the quote's, widened by the markup around it."""

    def spans(v: Column) -> Column:
        # Walk the pieces, counting raw characters and units (pieces that are no markup), up to the first and last unit.
        zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("unit"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

        def step(acc: Column, piece: Column) -> Column:
            shown = ~F.substring(piece, 1, 1).isin("*", "`")
            after = acc["pos"] + F.length(piece)
            return F.struct(
                after.alias("pos"), (acc["unit"] + shown.cast("int")).alias("unit"),
                F.when(shown & (acc["unit"] == v["first"]), acc["pos"]).otherwise(acc["start"]).alias("start"),
                F.when(shown & (acc["unit"] == v["last"]), after).otherwise(acc["end"]).alias("end"),
            )

        span = F.aggregate(F.regexp_extract_all(raw, F.lit(PIECES), F.lit(0)), zero, step)
        return F.when((F.length(F.trim(v["wanted"])) >= MIN_PROJECTED) & (v["first"] >= 0), _bound(span, widened))

    def widened(x: Column) -> Column:
        head, tail = F.substring(raw, F.lit(1), x["start"]), F.substring(raw, x["end"] + 1, F.length(raw))
        start = x["start"] - (F.length(head) - F.length(F.rtrim(head, F.lit(MARKUP))))
        end = x["end"] + (F.length(tail) - F.length(F.ltrim(tail, F.lit(MARKUP))))
        return F.struct(F.substring(raw, start + 1, end - start).alias("quote"), start.cast("long").alias("start"))

    def places(wanted: Column) -> Column:
        at = F.call_function("locate", wanted, projected(raw)) - 1
        return _bound(at, lambda x: F.struct(wanted.alias("wanted"), x.alias("first"), (x + F.length(wanted) - 1).alias("last")))

    return _bound(_bound(projected(quote), places), spans)


def align(fields: dict[str, Column], field: Column, quote: Column, context: Column | str) -> Column:
    """(field, quote, start, warnings) of the quote that ``field`` is said to hold, or null if no field holds it.

    The cited field is looked at first, then the others in order, word for word; then all again by projection.
    """
    context = F.lit(context) if isinstance(context, str) else context
    none = F.array().cast("array<string>")
    own = sum((F.when(field == f, i).otherwise(0) for i, f in enumerate(FIELDS, 1)), F.lit(0))  # 1 to 3; 0: no such field

    def chosen(how, note: str | None) -> Column:
        def pick(hits: Column) -> Column:
            place = F.when((own > 0) & F.get(hits, own - 1).isNotNull(), own)
            for i in range(len(FIELDS)):
                place = F.coalesce(place, F.when(hits[i].isNotNull(), F.lit(i + 1)))
            return _bound(place, lambda at: F.when(at.isNotNull(), described(F.get(hits, at - 1), F.element_at(F.array(*map(F.lit, FIELDS)), at))))

        def described(hit: Column, name: Column) -> Column:
            aligned = F.array(F.concat_ws(":", F.lit(note), context, name)) if note else none
            moved = F.when(name != field, F.array(F.concat(F.lit("evidence_quote_source_field_corrected:"), context, F.lit(":"), field, F.lit("->"), name))).otherwise(none)
            return F.struct(name.alias("field"), hit["quote"].alias("quote"), hit["start"].alias("start"), F.concat(aligned, moved).alias("warnings"))

        return _bound(F.array(*(how(F.coalesce(fields[f], F.lit("")), quote) for f in FIELDS)), pick)

    return F.coalesce(chosen(_exact, None), chosen(_by_projection, "evidence_quote_markdown_aligned"))
