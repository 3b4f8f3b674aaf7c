"""Exact deduplication by progressive refinement, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Three keys split the rows further and further: the length in
bytes, a hash of the first ``PREFIX`` characters, and the SHA-256 of the whole text. A group of one row at a level is
settled there; the full text is hashed only for rows whose (length, prefix) group still has others.

The keys that survive a level go to a table in the shared folder and are broadcast when there are at most
``BROADCAST_KEYS`` of them (two longs each); beyond that every row counts as a survivor, which hashes more and changes no
result. Only ids and keys are shuffled, never texts. Groups are aggregated to (key, salt) first and joined back at that
key, so a digest that a third of all rows share is spread over ``salts`` tasks and no task or driver holds a group.

Null text is empty text, and equal to it. The row with the largest id stays; rows that repeat an id are copies of one
another like any others (each is returned, ``kept`` is true for all rows with the largest id). A row without id is kept
only where no row of its group has one (``keep_id`` is null then). Very long texts are hashed whole. Empty tables give no rows.
Columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import StageTables, lower_ascii, two_columns

PREFIX = 64
BROADCAST_KEYS = 500_000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, salts: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row; digest is the binary SHA-256 of the normalised text.

    It is null for rows that the length or the prefix settled, unless ``digest_all`` asks for it.
    """
    rows = two_columns(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    tables = StageTables(docs.sparkSession, "dedup")
    lengths = rows.withColumn("len", F.octet_length("text").cast("long"))
    shared_len = tables.put("len", lengths.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"))
    first = _survivors(lengths, shared_len, ["len"], "live1")
    prefixed = first.withColumn("prefix", F.when(F.col("live1"), F.xxhash64(lower_ascii(F.substring("text", 1, PREFIX)))))
    groups = prefixed.where("live1").groupBy("len", "prefix").agg(F.count("*").alias("n"))
    shared_prefix = tables.put("prefix", groups.where("n > 1").select("len", "prefix"))
    second = _survivors(prefixed, shared_prefix, ["len", "prefix"], "live2")
    digest = F.unhex(F.sha2(lower_ascii(F.col("text")), 256))
    # What a level settled has a (length, prefix) of its own, written in digits: no digest looks like that.
    settled = F.encode(F.concat_ws(":", F.col("len").cast("string"), F.col("prefix").cast("string")), "utf-8")
    hashed = second.select("doc_id", F.when(F.col("live2") | F.lit(digest_all), digest).alias("digest"), "live2", settled.alias("settled"))
    salted = hashed.select("doc_id", "digest", F.when(F.col("live2"), F.col("digest")).otherwise(F.col("settled")).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    part = salted.groupBy("key", "salt").agg(F.max("doc_id").alias("most"), F.count("*").alias("n"))
    whole = part.groupBy("key").agg(F.max("most").alias("keep_id"), F.sum("n").alias("group_size"))
    spread = part.select("key", "salt").join(whole, "key")
    return salted.join(spread, ["key", "salt"]).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "digest")


def _survivors(rows: DataFrame, keys: DataFrame, on: list[str], flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether the key is among ``keys``; true for all where these are too many to broadcast."""
    if keys.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return rows.withColumn(flag, F.lit(True))
    found = rows.join(F.broadcast(keys.withColumn(flag, F.lit(True))), on, "left")
    return found.withColumn(flag, F.coalesce(flag, F.lit(False)))
