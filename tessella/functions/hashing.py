"""Hashes that identify content, order rows deterministically and name candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import coerce


def content_hash(name: Column | str, description: Column | str, body: Column | str) -> Column:
    """SHA-256 of the compact JSON object of the texts, keys in order; the same for equal content under any id."""
    return F.sha2(F.to_json(F.struct(coerce(body).alias("body"), coerce(description).alias("description"), coerce(name).alias("name"))), 256)


def source_hash(skill_id: Column | str, name: Column | str, description: Column | str, body: Column | str) -> Column:
    """``content_hash`` with the id among the keys."""
    return F.sha2(F.to_json(F.struct(coerce(body).alias("body"), coerce(description).alias("description"), coerce(name).alias("name"), coerce(skill_id).alias("skill_id"))), 256)


def stable_seed(seed: int | Column, value: Column | str) -> Column:
    """The first 8 bytes of SHA-256 of ``seed:value`` as an unsigned decimal."""
    text = F.concat_ws(":", F.lit(seed).cast("string") if isinstance(seed, int) else seed, F.col(value) if isinstance(value, str) else value)
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def order_key(*parts: Column | str | int) -> Column:
    """A reproducible shuffle: order rows by this digest of the parts."""
    return F.sha2(F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else p for p in parts]), 256)


def candidate_id(kind: str, *skill_ids: Column) -> Column:
    return F.concat(F.lit(f"comp::{kind}::"), F.substring(F.sha2(F.concat_ws("\u0000", F.lit(kind), *skill_ids), 256), 1, 16))
