"""The corpus pipeline: five stages over ``documents``, each by one operator of ``tessella.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``documents``. Rows without doc_id can't be named by a decision of the
stages that compare documents; those stages keep them.
Null texts, and texts without a letter, go at the first stage. Very long texts are read whole by every stage. Rows that
repeat an id stay or go together where a decision names their id; equal texts are copies whatever their ids. Ties: of equal
texts the largest id stays, of near ones the smallest. Empty tables pass through as empty tables. Columns beyond those of
``documents`` pass through under any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe_sql, decontam, exact_dedup, jaccard_join, langid
from tessella.llm.common import StageTables, without

#: Least posterior of the chosen language. It is shared out among the learned languages, so texts in none of them are told by
#: how unlikely their n-grams are (``langid.accepted``), not by this limit.
MIN_LANGUAGE_SCORE = 0.3

#: Chunks cached by a worker of the last stage, whose executors carry what the stages before it have left.
CACHE_KEYS = 200_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (or null), and those that the classifier gives to no language."""
    return langid.accepted(docs, langid.fit(docs, F.col("lang")), MIN_LANGUAGE_SCORE)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts."""
    return without(docs, exact_dedup.exact_groups(docs).where("not kept"), "exact")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each component at 0.8 of five-word shingles."""
    found = jaccard_join.similarity_components(docs, jaccard_join.Rule(k=5, num=80, den=100))
    return without(docs, found.where("doc_id <> component_id"), "near")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text kept, decoded again: digests of both, as in query op2_bpe."""
    out = bpe_sql.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), cache_keys=CACHE_KEYS)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: Language ID, similarity components and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    tables = StageTables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.put(name, stage(spark, docs, sf_dir))
    return docs
