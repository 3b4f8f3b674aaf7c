"""Roles that the star-schema and document tables play for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.lineage import cut, few


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and rows.rdd.getNumPartitions() < cores:  # a small table of one row group, else one task's work
        rows = rows.repartition(cores)
    return rows


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a pool of skills."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("skill_id"), F.substring("text", 1, 40).alias("name"), F.substring("text", 1, 300).alias("description"), F.col("text").alias("body"), F.col("source").alias("category"), F.col("lang").alias("language"), F.col("doc_id").alias("pool_idx"))


POOL = "(SELECT source || '/' || doc_id AS skill_id, text[1:40] AS name, text[1:300] AS description, text AS body, source AS category, lang AS language, doc_id AS pool_idx FROM documents)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"), "item_id")


TASKS = "(SELECT 'q' || item_id AS query_id, text AS query, item_id FROM benchmark)"


GRAM = 5


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, skill_id): the documents that hold a query's text word for word; found once, however often it is read."""
    return cut(holding(pool(spark, sf_dir), tasks(spark, sf_dir)).select("query_id", "skill_id"))


def holding(skills: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, query, skill_id, body): pairs whose body contains the query.

    The words inside a query, between its first and last blank, stand in such a body between blanks too. So pairs share
    the first ``GRAM`` inner words (all of them, if there are fewer), and are joined by these before the whole text is
    compared. Bodies give the grams of the lengths that queries ask for. Every query must hold a blank-free inner word.
    """
    words = F.split("query", " ")
    size = F.least(F.size(words) - 2, F.lit(GRAM))
    keyed = asked.select("query_id", "query", size.alias("size"), F.when(size < 1, F.raise_error(F.concat(F.lit("a query of two words or fewer: "), "query_id")).cast("long")).otherwise(F.xxhash64(F.slice(words, 2, F.greatest(size, F.lit(1))))).alias("gram"))
    keyed = few(cut(keyed))
    sizes = sorted(r[0] for r in keyed.select("size").distinct().collect())  # GRAM rows at most
    if not sizes:
        return asked.join(skills.select("skill_id", "body"), F.lit(False)).select("query_id", "query", "skill_id", "body")

    def grams(words: Column) -> Column:
        of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))
        return F.array_distinct(F.concat(*map(of, sizes)))

    # the words are split once and bound, not once a gram
    bound = F.transform(F.array(F.split("body", " ")), grams)[0]
    each = skills.where("body is not null").select("skill_id", F.explode(bound).alias("gram"))
    pairs = few(cut(each.join(keyed, "gram").select("query_id", "query", "skill_id").distinct()))
    return pairs.join(skills.select("skill_id", "body"), "skill_id").where(F.contains("body", "query"))


GOLD = f"(SELECT t.query_id, p.skill_id FROM {POOL} p JOIN {TASKS} t ON contains(p.body, t.query))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("skill_id"), F.col("vec_id").alias("pool_idx"), "embedding", "label")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract to each document: it makes its own first long words and needs those of the document before it."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 8)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.array_join(F.slice(words, 1, 3), " ").alias("made"))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("made").alias("needed"))
    both = docs.join(before, "doc_id", "left")
    make = lambda artifact, form, required: F.array(F.struct(artifact.alias("artifact"), F.lit(form).alias("format"), F.lit(required).alias("required")))
    return both.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("skill_id"),
        F.col("doc_id").alias("contract_idx"),
        F.sha2(F.col("doc_id").cast("string"), 256).alias("source_hash"),
        F.struct(F.when(F.col("doc_id") % 11 == 5, "failed").otherwise("validated").alias("status")).alias("extraction"),
        make(F.col("made"), "text", True).alias("outputs"),
        make(F.coalesce("needed", F.lit("")), "text", True).alias("inputs"),
        F.array(F.struct(F.coalesce("needed", F.lit("")).alias("name"))).alias("dependencies"),
        F.array(F.struct(F.when(F.col("doc_id") % 3 == 0, "generate").otherwise("validate").alias("action"))).alias("operations"),
    )


def single_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated query to a document, stale for every 13th."""
    docs = table(spark, sf_dir, "documents")
    key = F.when(F.col("doc_id") % 13 == 7, F.lit("stale")).otherwise(F.col("doc_id").cast("string"))
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("positive_skill_id"), F.sha2(key, 256).alias("source_hash"))
