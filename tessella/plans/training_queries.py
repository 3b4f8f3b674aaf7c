"""Registered queries of training sets, contracts, generation and incremental work."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tessella.functions import alignment
from tessella.functions import evidence as ev
from tessella.functions.fixed import QUERY_INSTRUCTION
from tessella.operators import contracts, dense, generation, training
from tessella.operators.lineage import cut, few
from tessella.plans import queries as plans
from tessella.plans import roles
from tessella.plans.queries import _BM25, _SIM, POOL, TASKS, query, sql_string
from tessella.streaming import incremental

_TOP = f"{_BM25}, names AS (SELECT pool_idx, skill_id FROM {POOL}), top AS (SELECT query_id, skill_id, score, rank FROM rk JOIN names USING (pool_idx))"


def _top(spark, sf, limit):
    pool = roles.pool(spark, sf)
    top = pool.select("pool_idx", "skill_id").join(few(plans._bm25_rank(spark, sf, limit)), "pool_idx")
    return cut(top.select("query_id", "skill_id", "score", "rank")), pool


@query(f"""WITH {_TOP}, p AS (SELECT query_id, skill_id FROM top WHERE rank = 1), n AS (SELECT query_id, skill_id, rank FROM top WHERE rank BETWEEN 2 AND 11)
SELECT t.query_id, p.skill_id AS positive_skill_id, sha256({sql_string(QUERY_INSTRUCTION)} || t.query[1:1500]) AS query_sha, (SELECT count(*) FROM n WHERE n.query_id = t.query_id) AS n_negatives, (SELECT string_agg(skill_id, ' ' ORDER BY rank) FROM n WHERE n.query_id = t.query_id) AS negatives FROM {TASKS} t JOIN p USING (query_id)""")
def biencoder_examples(spark, sf):
    top, pool = _top(spark, sf, 15)
    records = roles.tasks(spark, sf).join(top.where("rank = 1").select("query_id", F.col("skill_id").alias("positive_skill_id")), "query_id").select("query_id", "query", "positive_skill_id", F.array("positive_skill_id").alias("positives"), F.lit("single").alias("training_type"), F.lit(1.0).alias("loss_weight"))
    out = training.biencoder_examples(records, top.select("query_id", "skill_id", F.lit("bm25").alias("source"), F.col("rank").alias("position")), pool)
    return out.select("query_id", "positive_skill_id", F.sha2("query_text", 256).alias("query_sha"), F.size("negative_skill_ids").cast("long").alias("n_negatives"), F.when(F.size("negative_skill_ids") > 0, F.array_join("negative_skill_ids", " ")).alias("negatives"))


@query(f"""WITH {_TOP}, g AS (SELECT query_id, skill_id, score, rank, (rank % 7 = 2)::INT AS label FROM top WHERE rank <= 20 AND query_id NOT IN (SELECT query_id FROM {TASKS} WHERE item_id % 5 = 0))
SELECT query_id, skill_id, rank, score AS retrieval_score, label::BIGINT AS label FROM g""")
def reranker_groups(spark, sf):
    top, pool = _top(spark, sf, 30)
    golds = top.where("rank % 7 = 2").join(roles.tasks(spark, sf).where("item_id % 5 <> 0"), "query_id", "left_semi").select("query_id", "skill_id")
    out = training.reranker_groups(top, golds, pool).candidates
    return out.select("query_id", "skill_id", F.col("rank").cast("long").alias("rank"), "retrieval_score", F.col("label").cast("long").alias("label"))


_MIXED = f"""{_TOP}, s AS (SELECT query_id, skill_id AS positive_skill_id, 'single' AS training_type, 1.0::DOUBLE AS loss_weight FROM top WHERE rank = 1), m AS (SELECT query_id || '::positive-' || rank AS query_id, skill_id AS positive_skill_id, 'multi' AS training_type, 1.5::DOUBLE AS loss_weight FROM top WHERE rank <= 3), mixed AS (SELECT * FROM s UNION ALL SELECT * FROM m)"""


def _mixed(spark, sf):
    top, _ = _top(spark, sf, 3)
    asked = roles.tasks(spark, sf)
    single = asked.join(top.where("rank = 1").select("query_id", F.col("skill_id").alias("positive_skill_id")), "query_id")
    multi = asked.join(top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill_id"))), lambda x: x["skill_id"]).alias("positives")), "query_id")
    return training.mix(single, multi)


@query(f"WITH {_MIXED} SELECT * FROM mixed")
def mixed_records(spark, sf):
    return _mixed(spark, sf).biencoder.select("query_id", "positive_skill_id", "training_type", "loss_weight")


@query(f"WITH {_MIXED} SELECT training_type, count(*) AS n, round(sum(loss_weight), 6) AS mass, round(avg(loss_weight), 6) AS mean_weight FROM mixed GROUP BY 1")
def training_summary(spark, sf):
    return training.summary(_mixed(spark, sf).biencoder)


_LOSS = f"x AS (SELECT a.vec_id AS query_id, b.vec_id AS other, {_SIM} AS s FROM embeddings a JOIN embeddings b ON a.vec_id // 40 = b.vec_id // 40)"


def _similarities(spark, sf):
    # every vector has the others of its batch of 40 for in-batch documents
    v = roles.table(spark, sf, "embeddings").select(F.expr("vec_id div 40").alias("batch"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    other = v.toDF("batch", "other", "w")
    return v.join(other, "batch").select(F.col("vec_id").alias("query_id"), "other", dense.cosine(F.col("v"), F.col("w")).alias("s"))


@query(f"WITH {_LOSS} SELECT query_id, round(ln(sum(exp(s / 0.05 - 20.0))) - max(CASE WHEN other = query_id THEN s / 0.05 - 20.0 END), 6) AS loss FROM x GROUP BY 1")
def infonce_loss(spark, sf):
    return training.info_nce(_similarities(spark, sf).select("query_id", F.col("s").alias("similarity"), (F.col("other") == F.col("query_id")).alias("positive")), 0.05)


@query(f"WITH {_LOSS} SELECT query_id, round(ln(sum(exp(s))) - ln(sum(CASE WHEN other % 4 = query_id % 4 THEN exp(s) END)), 6) AS loss FROM x GROUP BY 1")
def listwise_loss(spark, sf):
    return training.listwise(_similarities(spark, sf).select("query_id", F.col("s").alias("score"), (F.col("other") % 4 == F.col("query_id") % 4).alias("positive")))


@query(f"SELECT query_id, CASE WHEN len(regexp_extract_all(query, '\\S+')) NOT BETWEEN 30 AND 45 THEN 'word_count' ELSE 'ok' END AS state FROM {TASKS}")
def query_validation(spark, sf):
    return roles.tasks(spark, sf).select("query_id", F.coalesce(generation.single_query_error("query", 30, 45), F.lit("ok")).alias("state"))



def _cited(spark, sf):
    docs = roles.table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    quote = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 11, 40)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("**"), F.substring("text", 11, 40), F.lit("`"))).otherwise(F.lit("no such text in any document"))
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("skill_id"), F.lit("").alias("name"), F.lit("").alias("description"), F.col("text").alias("body"), quote.alias("quote"), "doc_id")


# Every third document cites itself word for word, every third with markup put in, every third what it does not hold.
_QUOTES = """c AS (SELECT doc_id, coalesce(text, '') AS body, CASE doc_id % 3 WHEN 0 THEN coalesce(text, '')[11:50] WHEN 1 THEN '**' || coalesce(text, '')[11:50] || '`' ELSE 'no such text in any document' END AS quote FROM documents),
pj AS (SELECT *, regexp_replace(regexp_replace(body, '\\s(?:[*`]*\\s)*', ' ', 'g'), '[*`]', '', 'g') AS shown, regexp_replace(regexp_replace(quote, '\\s(?:[*`]*\\s)*', ' ', 'g'), '[*`]', '', 'g') AS wanted FROM c),
ex AS (SELECT doc_id, quote, CASE WHEN quote = '' THEN 0 ELSE strpos(body, quote) - 1 END AS start FROM pj WHERE quote = '' OR contains(body, quote)),
md AS (SELECT *, strpos(shown, wanted) AS first, strpos(shown, wanted) + length(wanted) - 1 AS last FROM pj WHERE doc_id NOT IN (SELECT doc_id FROM ex) AND length(trim(wanted)) >= 12 AND contains(shown, wanted)),
pc AS (SELECT doc_id, first, last, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT *, regexp_extract_all(body, '[*`]+|\\s(?:[*`]*\\s)*|[^\\s*`]') AS p FROM md)),
un AS (SELECT *, sum(length(piece)) OVER w AS stop, sum((piece[1:1] NOT IN ('*', '`'))::INT) OVER w AS unit FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
sp AS (SELECT doc_id, max(CASE WHEN unit = first THEN stop - length(piece) END) AS a, max(CASE WHEN unit = last THEN stop END) AS b FROM un WHERE piece[1:1] NOT IN ('*', '`') GROUP BY 1),
wd AS (SELECT doc_id, body, a - (a - length(rtrim(body[1:a], '*`'))) AS a, b + (length(body) - b - length(ltrim(body[b + 1:], '*`'))) AS b FROM sp JOIN md USING (doc_id)),
al AS (SELECT doc_id, quote, start, 0 AS warnings FROM ex UNION ALL SELECT doc_id, body[a + 1:b], a, 2 FROM wd)"""


@query(f"""WITH {_QUOTES} SELECT 'd' || c.doc_id AS skill_id, CASE WHEN al.doc_id IS NULL THEN 'missing' WHEN al.quote = '' THEN 'description' ELSE 'body' END AS field, al.quote, al.start::BIGINT AS start, CASE WHEN al.doc_id IS NULL OR al.quote = '' THEN 0 WHEN al.warnings = 2 THEN 2 ELSE 1 END::BIGINT AS n_warnings FROM c LEFT JOIN al USING (doc_id)""")
def evidence_align(spark, sf):
    """The quotes are said to stand in the description, which is empty, and are found in the body."""
    rows = _cited(spark, sf)
    found = alignment.align({f: F.col(f) for f in ev.FIELDS}, F.lit("description"), F.col("quote"), "capability")
    return rows.select("skill_id", found.alias("a")).select("skill_id", F.coalesce("a.field", F.lit("missing")).alias("field"), "a.quote", "a.start", F.coalesce(F.size("a.warnings"), F.lit(0)).cast("long").alias("n_warnings"))


@query("SELECT doc_id, doc_id % 2 = 0 AS leaks FROM documents")
def label_leak(spark, sf):
    docs = roles.table(spark, sf, "documents")
    name = F.concat(F.lit("zq-"), F.col("doc_id").cast("string"))
    asked = F.concat(F.lit("please run "), F.translate(name, "-", " "), F.when(F.col("doc_id") % 2 == 0, " Skill now").otherwise(" now"))
    return generation.label_leaks(docs.select("doc_id", asked.alias("query"), name.alias("name"))).select("doc_id", "leaks")


@query()
def fuzzy_duplicates(spark, sf):
    @F.pandas_udf("boolean")
    def same(a, b):
        return a.combine(b, lambda x, y: ev.same_statement(x, y, False))

    # sentence by sentence of the whole texts; one that has no counterpart is the same as none
    docs = roles.table(spark, sf, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n+").alias("a"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    each = docs.join(after, "doc_id").select("doc_id", F.posexplode(F.arrays_zip("a", "b")).alias("at", "x"))
    text = lambda f: F.coalesce(F.col("x")[f], F.lit(""))
    return each.select("doc_id", "at", same(text("a"), text("b")).alias("same"))


def _answers(spark, sf):
    """An answer to each document: a capability, an operation and an input that is a trigger, cited from its own text."""
    cite = lambda q: F.array(F.struct(F.lit("body").alias("source_field"), q.alias("quote")))
    none = F.array().cast("array<struct<statement:string,evidence_quotes:array<struct<source_field:string,quote:string>>>>")
    good, lost = F.substring("body", 11, 40), F.lit("no such text in any document")
    answer = F.struct(
        F.array(F.lit("en")).alias("source_languages"), F.lit("en").alias("canonical_language"),
        F.struct(F.lit("does something").alias("summary"), cite(F.when(F.col("doc_id") % 3 == 2, lost).otherwise(good)).alias("evidence_quotes")).alias("capability"),
        F.array(F.struct(F.lit("generate").alias("action"), F.lit("text").alias("target"), F.lit("text").alias("outcome"), F.array(F.lit("short")).alias("qualifiers"), cite(good).alias("evidence_quotes"))).alias("operations"),
        *[F.array().cast("array<struct<artifact:string>>").alias(f) for f in ("inputs", "outputs")], none.alias("preconditions"),
        F.array(F.struct(F.lit("must be short").alias("statement"), cite(good).alias("evidence_quotes"))).alias("constraints"), F.array().cast("array<struct<name:string>>").alias("dependencies"), none.alias("exclusions"),
        F.array(F.struct(F.lit("Must be short").alias("statement"), cite(good).alias("evidence_quotes"))).alias("quality_criteria"),
    )
    return _cited(spark, sf).withColumn("answer", F.to_json(answer))


@query("SELECT 'd' || doc_id AS skill_id, doc_id % 3 <> 2 AND length(trim(text[11:50])) > 0 AS made FROM documents")
def contract_materialize(spark, sf):
    return contracts.materialize_all(_answers(spark, sf)).select("skill_id", F.col("contract").isNotNull().alias("made"))


@query("SELECT 'd' || doc_id AS skill_id, doc_id % 2 = 0 AS valid FROM documents WHERE doc_id % 3 <> 2 AND length(trim(text[11:50])) > 0")
def contract_validation(spark, sf):
    rows = _answers(spark, sf)
    made = contracts.materialize_all(rows).where("contract is not null")
    changed = rows.drop("answer", "quote").join(made.select("skill_id", "contract"), "skill_id").withColumn("body", F.when(F.col("doc_id") % 2 == 0, F.col("body")).otherwise(F.concat(F.lit("x"), F.col("body"))))
    return contracts.check_all(changed).select("skill_id", F.col("error").isNull().alias("valid"))


def _complete(asked: list[dict]) -> str:
    """A client that answers by rule: short at first for every third candidate, good afterwards."""
    shown = json.loads(asked[1]["content"])
    ids = [s["skill_id"] for s in shown["skills"]]
    short = sum(map(ord, ids[0])) % 3 == 0 and len(asked) == 2
    step = {s: f"s{i}" for i, s in enumerate(ids)}
    return json.dumps({"query": "too short" if short else " ".join(["please"] * 40), "positive_skill_ids": ids, "subtasks": [{"step_id": step[s], "skill_id": s, "instruction": "do it"} for s in ids], "dependencies": [{"from_step_id": step[e["from_skill_id"]], "to_step_id": step[e["to_skill_id"]]} for e in shown["handoffs"]]})


@query()
def payload_validation(spark, sf):
    pairs = plans._graph(spark, sf).pairs
    edge = F.struct(F.col("skill_ids")[0].alias("from_skill_id"), F.col("skill_ids")[1].alias("to_skill_id"))
    rows = pairs.select("candidate_id", F.to_json(F.struct("candidate_id", "candidate_type", "skill_ids", F.array(edge).alias("edges"))).alias("candidate"), F.to_json(F.map_from_arrays("skill_ids", F.transform("skill_ids", lambda s: F.struct(F.sha2(s, 256).alias("source_hash"))))).alias("contracts"))
    out = generation.generate(rows, _complete)
    return out.select("candidate_id", F.col("attempts").cast("long").alias("attempts"), F.col("query").isNotNull().alias("made"), F.coalesce("review", F.lit("none")).alias("review"))


@query("SELECT 'd' || doc_id AS skill_id, CASE WHEN doc_id % 5 = 0 THEN 'ValueError' ELSE 'none' END AS error_type, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 1 END::BIGINT AS attempts FROM documents WHERE doc_id % 4 <> 0")
def incremental_resume(spark, sf):
    docs = roles.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("skill_id"), F.sha2("text", 256).alias("source_hash"), F.when(F.col("doc_id") % 5 == 0, "bad").otherwise("good").alias("prompt"), "doc_id")

    def work(prompt: str, feedback: str | None) -> str:
        if prompt == "bad":
            raise ValueError("cannot do it")
        return prompt

    out = incremental.run_batch(docs, docs.where("doc_id % 4 = 0"), work)
    return out.select("skill_id", F.coalesce("error_type", F.lit("none")).alias("error_type"), F.col("attempts").cast("long").alias("attempts"))
