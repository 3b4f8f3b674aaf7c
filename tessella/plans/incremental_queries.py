"""Registered queries of scans in order, id guards, keyed incremental work and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.operators import guards, manifests, training
from tessella.operators.lineage import shared_dir
from tessella.plans import roles
from tessella.plans.queries import POOL, TASKS, query
from tessella.plans.training_queries import _TOP, _top
from tessella.sources import jsonl
from tessella.streaming import keyed


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, length(text)::BIGINT AS n FROM documents QUALIFY ordinal < 700")
def scan_first(spark, sf):
    """The first 700 records of the documents as JSON lines."""
    docs, path = roles.table(spark, sf, "documents").select("doc_id", "text"), _folder(spark, "scan")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.option("ignoreNullFields", "false").json(path)
    return jsonl.first(spark, path, docs.schema, 700).select("doc_id", "ordinal", F.length("text").cast("long").alias("n"))


_TRIPLES = "list_filter([1, 7, 30], lambda k: doc_id >= k)"


@query(f"""WITH r AS (SELECT 'q' || doc_id AS query_id, unnest(list_transform({_TRIPLES}, lambda k: doc_id - k)) AS d, generate_subscripts({_TRIPLES}, 1) - 1 AS position FROM documents WHERE doc_id > 0)
SELECT r.query_id, r.position::BIGINT AS position, p.skill_id, p.category, p.language, length(p.body)::BIGINT AS n FROM r JOIN {POOL} p ON p.pool_idx = r.d""")
def guarded_positives(spark, sf):
    """Three earlier documents are a document's positives; ids and lists are guarded in the join's own shuffle."""
    pool = roles.pool(spark, sf)
    listed = F.filter(F.array(*(F.when(F.col("doc_id") >= k, F.col("doc_id") - k) for k in (1, 7, 30))), F.isnotnull)
    asked = roles.table(spark, sf, "documents").where("doc_id > 0").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"), F.transform(listed, lambda d: d.cast("string")).alias("positive_skill_ids"))
    named = pool.select(F.col("pool_idx").cast("string").alias("skill_id"), F.col("skill_id").alias("name"), "category", "language", "body")
    out = guards.positives(asked, named)
    return out.select("query_id", F.col("position").cast("long").alias("position"), F.col("name").alias("skill_id"), "category", "language", F.length("body").cast("long").alias("n"))


def _skills(spark, sf):
    docs = roles.table(spark, sf, "documents")
    return docs.select(F.lit("query").alias("stage"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("skill_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_hash"), F.col("doc_id").alias("ordinal"), "doc_id")


def _contracts(spark, sf):
    """No contract for every fourth document, one of an older text for every sixth."""
    docs = _skills(spark, sf).where("doc_id % 4 <> 1")
    return docs.select("skill_id", F.when(F.col("doc_id") % 6 == 0, "older").otherwise(F.col("source_hash")).alias("source_hash"), F.concat(F.lit("contract "), F.col("skill_id")).alias("contract"))


_KEYS = "'d' || doc_id AS skill_id, sha256(coalesce(text, '')) AS source_hash"
_FAILED = "SELECT 'query' AS stage, skill_id, source_hash, attempts::BIGINT AS attempts, error_type, error, raw_response FROM"


@query(f"""SELECT 'query' AS stage, {_KEYS}, CASE WHEN doc_id % 4 = 1 OR doc_id % 6 = 0 THEN 'failure' ELSE 'result' END AS status,
    CASE WHEN doc_id % 4 = 1 OR doc_id % 6 = 0 THEN 0 ELSE 1 END::BIGINT AS attempts, CASE WHEN doc_id % 4 = 1 OR doc_id % 6 = 0 THEN '{keyed.NO_CONTRACT}' END AS error,
    CASE WHEN NOT (doc_id % 4 = 1 OR doc_id % 6 = 0) THEN 'contract d' || doc_id END AS response FROM documents""")
def missing_contracts(spark, sf):
    """Skills joined to contracts by id and source hash: those without one fail with no attempt, the others are worked."""
    rows = keyed.with_contracts(_skills(spark, sf), _contracts(spark, sf)).withColumnRenamed("contract", "prompt")
    none = rows.where("false")
    out = keyed.run_batch(rows, none, keyed.Worker(lambda prompt, feedback: prompt))
    return out.select(*keyed.KEY, "status", F.col("attempts").cast("long").alias("attempts"), "error", "response")


def _answer(prompt: str, feedback: str | None) -> str:
    if prompt == "down":
        raise ConnectionError("no answer")
    return f"{prompt}, told {feedback}"


def _accept(row: dict, answer: str) -> str:
    if answer.startswith("refused"):
        raise ValueError("not accepted")
    return answer


_TWICE = """SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'none' WHEN doc_id % 5 = 0 THEN 'refused' WHEN doc_id % 7 = 0 THEN 'down' ELSE 'none' END AS fate FROM documents"""


@query(f"""WITH d AS ({_TWICE})
SELECT 'query' AS stage, {_KEYS}, CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 3 END::BIGINT AS attempts, CASE fate WHEN 'down' THEN 'ConnectionError' ELSE 'ValueError' END AS error_type,
    CASE fate WHEN 'down' THEN 'no answer' ELSE 'not accepted' END AS error, CASE fate WHEN 'refused' THEN 'refused, told ValueError: not accepted' END AS raw_response FROM d WHERE fate <> 'none'""")
def failure_rows(spark, sf):
    """Failures that are left after a stream with a restart: even documents come again, those of every tenth mended."""
    return _failed_stream(spark, sf)[1].select(*keyed.KEY, F.col("attempts").cast("long").alias("attempts"), "error_type", "error", "raw_response")


@query(f"""WITH d AS ({_TWICE}) SELECT 'query' AS stage, {_KEYS}, CASE WHEN doc_id % 10 = 0 THEN 4 ELSE 1 END::BIGINT AS attempts, CASE WHEN doc_id % 10 = 0 THEN 'mended' ELSE 'fine' END || ', told None' AS response FROM d WHERE fate = 'none'""")
def keyed_results(spark, sf):
    """Results of the same stream: every key once, however often it came."""
    return _failed_stream(spark, sf)[0].select(*keyed.KEY, F.col("attempts").cast("long").alias("attempts"), "response")


def _failed_stream(spark, sf):
    rows, path = _skills(spark, sf), _folder(spark, "keyed")
    first = F.when(F.col("doc_id") % 5 == 0, "refused").when(F.col("doc_id") % 7 == 0, "down").otherwise("fine")
    again = F.when(F.col("doc_id") % 10 == 0, "mended").otherwise(first)
    columns = [*keyed.KEY, "ordinal", "prompt"]
    parts = [rows.withColumn("prompt", first).select(columns), rows.where("doc_id % 2 = 0").withColumn("prompt", again).select(columns)]
    with keyed.state_store(spark):
        for part in parts:
            # a row that comes twice in a batch: the second is skipped
            part.unionByName(part.where("ordinal % 3 = 0").withColumns({"ordinal": F.col("ordinal") + 10**12, "prompt": F.lit("fine")})).write.mode("append").parquet(f"{path}/in")
            keyed.run_stream(spark.readStream.schema(parts[0].schema).parquet(f"{path}/in"), keyed.Worker(_answer, _accept), f"{path}/out", f"{path}/state").awaitTermination()
    records = spark.read.schema(keyed.RECORD).parquet(f"{path}/out")
    return keyed.results(records), keyed.failures(records)


@query(f"""WITH {_TOP}, x AS (SELECT t.query_id, p.skill_id AS positive, (SELECT list(n.skill_id ORDER BY n.rank) FROM top n WHERE n.query_id = t.query_id AND n.rank BETWEEN 2 AND 11) AS negatives,
    CASE WHEN t.item_id % 3 = 0 THEN 'multi' ELSE 'single' END AS kind, CASE WHEN t.item_id % 3 = 0 THEN 1.5 ELSE 1.0 END AS weight FROM {TASKS} t JOIN (SELECT * FROM top WHERE rank = 1) p USING (query_id)),
s AS (SELECT unnest(range(len(negatives))) AS i FROM x)
SELECT 'examples' AS measure, count(*)::DOUBLE AS value FROM x UNION ALL SELECT 'type:' || kind, count(*)::DOUBLE FROM x GROUP BY kind UNION ALL SELECT 'mass:' || kind, sum(weight)::DOUBLE FROM x GROUP BY kind
UNION ALL SELECT 'negatives', coalesce(sum(len(negatives)), 0)::DOUBLE FROM x UNION ALL SELECT 'source:' || CASE WHEN i % 2 = 0 THEN 'bm25' ELSE 'random' END, count(*)::DOUBLE FROM s GROUP BY i % 2
UNION ALL SELECT 'digest', (sum(('0x' || md5(concat_ws(chr(31), query_id, positive, coalesce(array_to_string(negatives, ' '), '')))[1:15])::HUGEINT) % 9007199254740992)::DOUBLE FROM x""")
def training_manifest(spark, sf):
    """Measures of bi-encoder examples, gathered while they are written."""
    top, pool = _top(spark, sf, 15)
    best = top.where("rank = 1").select("query_id", F.col("skill_id").alias("positive_skill_id"))
    multi = F.col("item_id") % 3 == 0
    records = roles.tasks(spark, sf).join(best, "query_id").select("query_id", "query", "positive_skill_id", F.array("positive_skill_id").alias("positives"), F.when(multi, "multi").otherwise("single").alias("training_type"), F.when(multi, 1.5).otherwise(1.0).alias("loss_weight"))
    source = F.when(F.col("rank") % 2 == 0, "bm25").otherwise("random")
    examples = training.biencoder_examples(records, top.select("query_id", "skill_id", source.alias("source"), F.col("rank").alias("position")), pool)
    measures = manifests.training_measures(["multi", "single"], ["bm25", "random"])
    measures["digest"] = manifests.digest("query_id", "positive_skill_id", F.array_join("negative_skill_ids", " "))
    found = manifests.write_with_measures(examples, _folder(spark, "manifest"), measures)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items() if not k.startswith("invalid")], "measure string, value double")
