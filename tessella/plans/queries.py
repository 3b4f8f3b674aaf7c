"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import hashing, text
from tessella.functions.fixed import ARTIFACT_STOP_WORDS, CONSUMER_ACTIONS, QUERY_INSTRUCTION, RERANK_INSTRUCTION
from tessella.operators import bm25, dense, fusion, graph, metrics, negatives, permutation, retrieval, sampling
from tessella.operators.lineage import cut
from tessella.plans import roles
from tessella.plans.roles import GOLD, POOL, TASKS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENS = text.tokens


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


# ---- SQL fragments ----------------------------------------------------------------------------------------------------
def sql_fold(x: str) -> str:
    return f"replace(translate(lower({x}), 'ςſµ', 'σsμ'), 'ß', 'ss')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({sql_fold(x)}, '[\\p{{L}}\\p{{N}}]+')"


def sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def sql_trigrams(t: str) -> str:
    """Of a column of folded text with single blanks."""
    return f"(CASE WHEN length({t}) = 0 THEN []::VARCHAR[] WHEN length({t}) < 3 THEN [{t}] ELSE list_distinct(list_transform(list_zip(string_split({t}, '')[:-3], string_split({t}, '')[2:-2], string_split({t}, '')[3:]), lambda x: x[1] || x[2] || x[3])) END)"


def sql_squeezed(x: str) -> str:
    return sql_strip(f"regexp_replace({sql_fold(x)}, '\\s+', ' ', 'g')")


def sql_string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# ---- text -------------------------------------------------------------------------------------------------------------
@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY token")
def tokens_vocab(spark, sf):
    rows = roles.table(spark, sf, "documents").select("doc_id", F.explode(TOKENS("text")).alias("token"))
    per_doc = rows.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


@query(f"SELECT doc_id, sha256(array_to_string({sql_tokens('text')}, ' ')) AS normalized_sha FROM documents")
def text_normalized(spark, sf):
    return roles.table(spark, sf, "documents").select("doc_id", F.sha2(F.array_join(TOKENS("text"), " "), 256).alias("normalized_sha"))


@query(f"""WITH t AS (SELECT doc_id, {sql_squeezed('text')} AS t FROM documents), g AS (SELECT doc_id, {sql_trigrams('t')} AS g FROM t)
SELECT a.doc_id, len(a.g)::BIGINT AS n_grams, round(coalesce(len(list_intersect(a.g, b.g))::DOUBLE / nullif(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)), 0), 0), 6) AS jaccard FROM g a JOIN g b ON b.doc_id = a.doc_id + 1""")
def trigram_jaccard(spark, sf):
    g = roles.table(spark, sf, "documents").select("doc_id", text.trigrams("text").alias("g"))
    after = g.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return g.join(after, "doc_id").select("doc_id", F.size("g").cast("long").alias("n_grams"), F.round(text.jaccard("g", "h"), 6).alias("jaccard"))


@query(f"SELECT category, count(*) AS n FROM (SELECT coalesce(nullif(trim(lower(CASE WHEN pool_idx % 3 = 0 THEN NULL WHEN pool_idx % 3 = 1 THEN ' ' || upper(category) || ' ' ELSE category END)), ''), nullif(trim(lower(split_part(skill_id, '/', 1))), ''), 'other') AS category FROM {POOL}) GROUP BY 1")
def category_norm(spark, sf):
    given = F.when(F.col("pool_idx") % 3 == 0, F.lit(None)).when(F.col("pool_idx") % 3 == 1, F.concat(F.lit(" "), F.upper("category"), F.lit(" "))).otherwise(F.col("category"))
    return roles.pool(spark, sf).select(text.category(given, "skill_id").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(f"SELECT lang_group, count(*) AS n FROM (SELECT CASE WHEN pool_idx % 2 = 0 THEN language WHEN regexp_matches(concat_ws(' ', name, description, body)[1:4000], '[A-Za-z]') THEN 'latin' ELSE 'und' END AS lang_group FROM {POOL}) GROUP BY 1")
def language_group(spark, sf):
    tag = F.when(F.col("pool_idx") % 2 == 0, F.col("language"))
    return roles.pool(spark, sf).select(text.language_group(tag, "name", "description", "body").alias("lang_group")).groupBy("lang_group").agg(F.count("*").alias("n"))


@query(f"SELECT skill_id, sha256(name || ' | ' || description[1:300] || ' | ' || body[1:2500]) AS text_sha, length(name || ' | ' || description[1:300] || ' | ' || body[1:2500])::BIGINT AS n_chars FROM {POOL}")
def format_skill(spark, sf):
    t = text.format_skill("name", "description", "body")
    return roles.pool(spark, sf).select("skill_id", F.sha2(t, 256).alias("text_sha"), F.length(t).cast("long").alias("n_chars"))


@query(f"SELECT query_id, {sql_string(QUERY_INSTRUCTION)} || query[1:1500] AS prompt FROM {TASKS}")
def format_query(spark, sf):
    return roles.tasks(spark, sf).select("query_id", text.format_query("query").alias("prompt"))


_PROMPT = f"'<Instruct>: ' || {sql_string(RERANK_INSTRUCTION)} || chr(10) || chr(10) || '<Query>: ' || t.query || chr(10) || chr(10)"


@query(f"""SELECT t.query_id, f.form, sha256({_PROMPT} || CASE f.form WHEN 'flat-full' THEN '<Document>: ' || p.name || ' | ' || p.description[1:500] || ' | ' || p.body[1:2000] WHEN 'flat-nd' THEN '<Document>: ' || p.name || ' | ' || p.description[1:500]
ELSE '<Skill>:' || chr(10) || '<Name>: ' || p.name || chr(10) || '<Description>: ' || p.description[1:500] || chr(10) || '<Body>: ' || p.body[1:2000] END) AS prompt_sha
FROM {TASKS} t JOIN {POOL} p ON p.pool_idx = t.item_id, (VALUES ('flat-full'), ('flat-nd'), ('struct')) f(form)""")
def rerank_prompt(spark, sf):
    both = roles.tasks(spark, sf).join(roles.pool(spark, sf), F.col("item_id") == F.col("pool_idx"))
    forms = F.array(*[F.struct(F.lit(f).alias("form"), F.sha2(text.rerank_prompt("query", "name", "description", "body", f), 256).alias("prompt_sha")) for f in text.RERANK_FORMATS])
    return both.select("query_id", F.inline(forms))


@query(f"SELECT item_id, length(query) - length(replace(query, ' ', '')) + 1 >= 0 AS ok, len(regexp_extract_all(query, '\\S+'))::BIGINT AS n_words FROM {TASKS}")
def word_counts(spark, sf):
    return roles.tasks(spark, sf).select("item_id", F.lit(True).alias("ok"), text.word_count("query").cast("long").alias("n_words"))


# ---- hashes -----------------------------------------------------------------------------------------------------------
def _json(*pairs: tuple[str, str]) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || to_json({v})" for k, v in pairs) + " || '}'"


@query(f"SELECT min(pool_idx) AS pool_idx, count(*) AS n FROM {POOL} GROUP BY name, description, body")
def content_dedup(spark, sf):
    keyed = roles.pool(spark, sf).select("pool_idx", hashing.content_hash("name", "description", "body").alias("hash"))
    return keyed.groupBy("hash").agg(F.min("pool_idx").alias("pool_idx"), F.count("*").alias("n")).drop("hash")


@query(f"SELECT skill_id, sha256({_json(('body', 'body'), ('description', 'description'), ('name', 'name'), ('skill_id', 'skill_id'))}) AS source_hash FROM {POOL}")
def source_hash(spark, sf):
    return roles.pool(spark, sf).select("skill_id", hashing.source_hash("skill_id", "name", "description", "body").alias("source_hash"))


@query(f"SELECT skill_id, 'comp::pair::' || sha256('pair' || chr(0) || skill_id || chr(0) || 'x/' || pool_idx)[1:16] AS candidate_id FROM {POOL}")
def candidate_ids(spark, sf):
    other = F.concat(F.lit("x/"), F.col("pool_idx").cast("string"))
    return roles.pool(spark, sf).select("skill_id", hashing.candidate_id("pair", F.col("skill_id"), other).alias("candidate_id"))


@query(f"SELECT skill_id, row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || category || ':' || skill_id), skill_id) AS place FROM {POOL}")
def stable_order(spark, sf):
    w = Window.partitionBy("category").orderBy(hashing.order_key(42, F.col("category"), F.col("skill_id")), "skill_id")
    return roles.pool(spark, sf).select("skill_id", F.row_number().over(w).cast("long").alias("place"))


# ---- retrieval --------------------------------------------------------------------------------------------------------
_TERMS = f"""d AS (SELECT pool_idx, {sql_tokens('body')} AS toks FROM {POOL}),
st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM d),
post AS (SELECT token, pool_idx, dl, count(*) AS tf FROM (SELECT pool_idx, len(toks) AS dl, unnest(toks) AS token FROM d) GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, st GROUP BY token)"""
_BM25 = f"""{_TERMS},
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens('query')}) AS token FROM {TASKS}) GROUP BY ALL),
sc AS (SELECT query_id, pool_idx, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (token) JOIN post USING (token), st GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_idx) AS rank FROM sc WHERE score > 0)"""


@query(f"WITH {_TERMS} SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_df_idf(spark, sf):
    ix = bm25.index(roles.pool(spark, sf), "body", TOKENS)
    return ix.terms.select("token", "df", F.round("idf", 6).alias("idf"))


def _bm25_rank(spark, sf, limit):
    """The ranking, ``limit`` rows a query, worked out once however often it is read."""
    return cut(bm25.rank(roles.pool(spark, sf), "body", roles.tasks(spark, sf), "query", limit, tokenize=TOKENS).withColumn("rank", F.col("rank").cast("long")))


@query(f"WITH {_BM25} SELECT query_id, pool_idx, score, rank FROM rk WHERE rank <= 20")
def bm25_rank(spark, sf):
    return _bm25_rank(spark, sf, 20)


@query(f"""WITH {_BM25.replace("FROM " + TASKS, "FROM (SELECT query_id, 'zzqx ' || query[1:5] AS query FROM " + TASKS + ")")},
pad AS (SELECT query_id, pool_idx, score FROM rk WHERE rank <= 10 UNION ALL SELECT t.query_id, h.pool_idx, 0.0 FROM {TASKS} t, (SELECT pool_idx FROM {POOL} ORDER BY pool_idx LIMIT 20) h WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.query_id = t.query_id AND rk.pool_idx = h.pool_idx AND rank <= 10))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_idx) AS rank FROM pad) WHERE rank <= 10""")
def bm25_topk_padded(spark, sf):
    few = roles.tasks(spark, sf).withColumn("query", F.concat(F.lit("zzqx "), F.substring("query", 1, 5)))
    return bm25.topk(roles.pool(spark, sf), "body", few, "query", 10, tokenize=TOKENS).withColumn("rank", F.col("rank").cast("long"))


_SIM = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_DENSE = f"dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_idx) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS pool_idx, {_SIM} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0))"


@query(f"WITH {_DENSE} SELECT query_id, pool_idx, score, rank FROM dn WHERE rank <= 10")
def dense_topk(spark, sf):
    v = roles.table(spark, sf, "embeddings")
    asked = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.semantic_topk(asked, v.select(F.col("vec_id").alias("pool_idx"), "embedding"), 10).withColumn("rank", F.col("rank").cast("long"))


# Two vectors stand for the embeddings of a query and of a document of the same number.
_S12 = "concat_ws(' | ', coalesce(name, ''), coalesce(description, '')[1:300], coalesce(body, '')[1:2500])"
_PADDED = f"""{_BM25.replace(sql_tokens('body'), sql_tokens(_S12))},
pad AS (SELECT query_id, pool_idx, score FROM rk WHERE rank <= 100 UNION ALL SELECT t.query_id, h.pool_idx, 0.0 FROM {TASKS} t, (SELECT pool_idx FROM {POOL} ORDER BY pool_idx LIMIT 200) h WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.query_id = t.query_id AND rk.pool_idx = h.pool_idx AND rank <= 100)),
lx AS (SELECT query_id, pool_idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_idx) AS rank FROM pad)"""
_HYBRID = f"""{_PADDED}, names AS (SELECT pool_idx, skill_id FROM {POOL}),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_idx) AS rank FROM (SELECT t.query_id, b.vec_id AS pool_idx, {_SIM} AS score FROM {TASKS} t JOIN embeddings a ON a.vec_id = t.item_id, embeddings b WHERE b.vec_id IN (SELECT pool_idx FROM names))),
bt AS (SELECT query_id, pool_idx, rank, 0 AS src FROM lx WHERE rank <= 100 UNION ALL SELECT query_id, pool_idx, rank, 1 FROM dn WHERE rank <= 100),
fs AS (SELECT query_id, skill_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 9) AS score FROM bt JOIN names USING (pool_idx) GROUP BY ALL),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, skill_id) AS rank FROM fs)"""


@query(f"WITH {_PADDED} SELECT query_id, skill_id, score, rank FROM lx JOIN (SELECT pool_idx, skill_id FROM {POOL}) USING (pool_idx) WHERE rank <= 100")
def bm25_s12(spark, sf):
    return retrieval.lexical(roles.pool(spark, sf), roles.tasks(spark, sf), 100, TOKENS).withColumn("rank", F.col("rank").cast("long"))


def _hybrid(spark, sf, top_k=50, depth=100):
    pool = roles.pool(spark, sf)
    v = roles.table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = roles.tasks(spark, sf).join(v, F.col("item_id") == F.col("vec_id")).select("query_id", "embedding")
    there = v.join(pool, F.col("vec_id") == F.col("pool_idx"), "left_semi").select(F.col("vec_id").alias("pool_idx"), "embedding")
    return retrieval.hybrid(pool, roles.tasks(spark, sf), there, asked, top_k, depth, tokenize=TOKENS)


@query(f"WITH {_HYBRID} SELECT query_id, skill_id, score, rank FROM hy WHERE rank <= 50")
def hybrid_topk(spark, sf):
    return _hybrid(spark, sf).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_BM25}, r1 AS (SELECT query_id, pool_idx AS item, rank FROM rk WHERE rank <= 10), r2 AS (SELECT query_id, pool_idx + rank % 3 AS item, rank FROM rk WHERE rank <= 10),
s AS (SELECT query_id, item, 'a' AS src, min(rank) AS rank FROM r1 GROUP BY ALL UNION ALL SELECT query_id, item, 'b', min(rank) FROM r2 GROUP BY ALL),
f AS (SELECT query_id, item, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 9) AS score FROM s GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM f) WHERE rank <= 8""")
def rrf_fusion(spark, sf):
    top = _bm25_rank(spark, sf, 10)
    first = top.select("query_id", F.col("pool_idx").alias("item"), "rank")
    second = top.select("query_id", (F.col("pool_idx") + F.col("rank") % 3).alias("item"), "rank")
    return fusion.reciprocal_rank_fusion([first, second], 8, key="item").withColumn("rank", F.col("rank").cast("long"))


# ---- evaluation -------------------------------------------------------------------------------------------------------
_K = {"ndcg": (1, 3, 10), "recall": (10, 20, 50), "full_coverage": (1, 3, 5, 10)}
_METRIC_SQL = ", ".join(
    [f"round(CASE WHEN id{k} > 0 THEN coalesce(d{k}, 0) / id{k} ELSE 0 END, 6) AS ndcg_{k}" for k in _K["ndcg"]]
    + ["round(CASE WHEN h1 > 0 THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS hit_1", "round(coalesce(h3, 0) / 3.0::DOUBLE, 6) AS precision_3", "round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr_10"]
    + [f"round(coalesce(h{k}, 0) / n_gold::DOUBLE, 6) AS recall_{k}" for k in _K["recall"]]
    + [f"(CASE WHEN coalesce(h{k}, 0) >= n_gold THEN 1.0 ELSE 0.0 END)::DOUBLE AS full_coverage_{k}" for k in _K["full_coverage"]]
)
_GRADE = "CASE WHEN l.quality = 1 THEN 3.0 ELSE 2.0 END"
_EVAL = f"""{_HYBRID},
gold AS (SELECT g.query_id, g.skill_id, ({_GRADE})::DOUBLE AS grade FROM {GOLD} g JOIN names n USING (skill_id) LEFT JOIN labels l ON l.doc_id = n.pool_idx),
ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
hit AS (SELECT h.query_id, h.rank, g.grade FROM hy h JOIN gold g USING (query_id, skill_id) WHERE h.rank <= 50),
ag AS (SELECT query_id, {", ".join(f"sum(CASE WHEN rank <= {k} THEN grade / log2(rank + 1) ELSE 0 END) AS d{k}" for k in (1, 3, 10))}, {", ".join(f"sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS h{k}" for k in (1, 3, 5, 10, 20, 50))}, min(CASE WHEN rank <= 10 THEN rank END) AS first FROM hit GROUP BY 1),
il AS (SELECT query_id, {", ".join(f"sum(CASE WHEN r <= {k} THEN grade / log2(r + 1) ELSE 0 END) AS id{k}" for k in (1, 3, 10))} FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM gold) GROUP BY 1),
det AS (SELECT ng.query_id, CASE WHEN n_gold = 1 THEN 'single' ELSE 'multi' END AS stratum, {_METRIC_SQL} FROM ng LEFT JOIN ag USING (query_id) LEFT JOIN il USING (query_id))"""


def _evaluation(spark, sf):
    pool = roles.pool(spark, sf)
    grades = pool.join(roles.table(spark, sf, "labels"), F.col("pool_idx") == F.col("doc_id"), "left").select("skill_id", F.when(F.col("quality") == 1, 3.0).otherwise(2.0).alias("grade"))
    golds = roles.gold(spark, sf).join(grades, "skill_id").groupBy("query_id").agg(F.collect_list("skill_id").alias("gold"), F.map_from_entries(F.collect_list(F.struct("skill_id", "grade"))).alias("relevance"))
    tasks = roles.tasks(spark, sf).join(golds, "query_id", "left").select("query_id", F.coalesce("gold", F.array().cast("array<string>")).alias("gold"), "relevance", (F.col("item_id") % 9 == 8).alias("generic_only"))
    return tasks, metrics.evaluate(tasks, cut(_hybrid(spark, sf)), pool)


@query(f"WITH {_EVAL} SELECT * FROM det WHERE query_id IN (SELECT query_id FROM {TASKS} WHERE item_id % 9 <> 8)")
def ir_metrics_per_query(spark, sf):
    return _evaluation(spark, sf)[1].details


@query(f"""WITH {_EVAL}, d2 AS (SELECT * FROM det WHERE query_id IN (SELECT query_id FROM {TASKS} WHERE item_id % 9 <> 8)), sides AS (SELECT * FROM d2 UNION ALL SELECT * REPLACE ('all' AS stratum) FROM d2)
SELECT stratum, {", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS)}, count(*) AS "count" FROM sides GROUP BY 1""")
def ir_metrics_summary(spark, sf):
    return _evaluation(spark, sf)[1].summary


@query(f"SELECT count(*) FILTER (WHERE item_id % 9 = 8) AS skipped_generic_only, count(*) FILTER (WHERE item_id % 9 <> 8 AND g.query_id IS NULL) AS skipped_no_gt_in_pool, 0::BIGINT AS skipped_missing_prediction FROM {TASKS} t LEFT JOIN (SELECT DISTINCT query_id FROM {GOLD}) g USING (query_id)")
def eval_skips(spark, sf):
    return _evaluation(spark, sf)[1].skipped


@query(f"SELECT DISTINCT skill_id FROM {GOLD}")
def benchmark_ids(spark, sf):
    golds = roles.gold(spark, sf).groupBy("query_id").agg(F.collect_list("skill_id").alias("gold_skill_ids"), F.create_map(F.max("skill_id"), F.lit(1.0)).alias("relevance"))
    return sampling.benchmark_ids(golds)


# ---- filters and negatives --------------------------------------------------------------------------------------------
# Pairs: each query's ten best lexical matches against the best one.
_PAIRS = f"""{_BM25}, names AS (SELECT pool_idx, skill_id FROM {POOL}), top AS (SELECT query_id, skill_id, rank FROM rk JOIN names USING (pool_idx) WHERE rank <= 10),
pairs AS (SELECT a.query_id, a.skill_id AS positive_skill_id, b.skill_id FROM top a JOIN top b USING (query_id) WHERE a.rank = 1)"""
_REASON = f"""sq AS (SELECT skill_id, array_to_string({sql_tokens('name')}, ' ') AS name_key, {sql_strip('body')} AS body_key, {sql_squeezed('body')} AS t FROM {POOL}),
sk AS (SELECT *, {sql_trigrams('t')} AS g FROM sq WHERE skill_id IN (SELECT skill_id FROM pairs UNION SELECT positive_skill_id FROM pairs)),
fl AS (SELECT x.query_id, x.positive_skill_id, x.skill_id, CASE WHEN p.skill_id = c.skill_id THEN 'same_skill_id' WHEN p.name_key <> '' AND p.name_key = c.name_key THEN 'same_normalized_name' WHEN p.body_key <> '' AND p.body_key = c.body_key THEN 'same_body'
WHEN len(list_intersect(p.g, c.g))::DOUBLE / (len(p.g) + len(c.g) - len(list_intersect(p.g, c.g))) >= 0.6 THEN 'high_body_trigram_overlap' END AS reason FROM pairs x JOIN sk p ON p.skill_id = x.positive_skill_id JOIN sk c ON c.skill_id = x.skill_id)"""


@query(f"WITH {_PAIRS}, {_REASON} SELECT query_id, skill_id, coalesce(reason, 'kept') AS reason FROM fl")
def identity_filter(spark, sf):
    pool = roles.pool(spark, sf)
    top = _bm25_rank(spark, sf, 10).join(pool.select("pool_idx", "skill_id"), "pool_idx")
    best = top.where("rank = 1").select("query_id", F.col("skill_id").alias("positive_skill_id"))
    pairs = top.select("query_id", "skill_id").join(best, "query_id")
    return negatives.flag_identity(pairs, pool, 0.6).select("query_id", "skill_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


_FN = f"""top AS (SELECT query_id, pool_idx, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_idx) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS pool_idx, {_SIM} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0)) WHERE rank <= 20),
ps AS (SELECT vec_id AS query_id, p.ord, (vec_id + p.step) % (SELECT count(*) FROM embeddings) AS pos FROM embeddings, (VALUES (0, 0), (1, 7), (2, 19)) p(ord, step) WHERE vec_id % 10 = 0),
hits AS (SELECT t.query_id, t.pool_idx, ps.ord, ps.pos, {_SIM} AS sim FROM top t JOIN ps USING (query_id) JOIN embeddings a ON a.vec_id = t.pool_idx JOIN embeddings b ON b.vec_id = ps.pos),
fs AS (SELECT query_id, pool_idx, min_by(pos, ord) AS pos, min_by(sim, ord) AS sim FROM hits WHERE sim >= 0.3 GROUP BY ALL)"""


def _false_negatives(spark, sf):
    v = roles.vectors(spark, sf)
    raw = roles.table(spark, sf, "embeddings")
    n = raw.count()
    asked = raw.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = dense.semantic_topk(asked, v.select("pool_idx", "embedding"), 20)
    spot = lambda step: F.concat(F.lit("v"), ((F.col("query_id") + step) % n).cast("string"))
    cands = top.select("query_id", F.concat(F.lit("v"), F.col("pool_idx").cast("string")).alias("skill_id"), "score", F.lit("semantic").alias("source"), F.array(spot(0), spot(7), spot(19)).alias("positives"))
    return negatives.filter_false_negatives(cands, v.select("skill_id", "embedding"), 0.3)


@query(f"WITH {_FN} SELECT query_id, 'v' || pool_idx AS skill_id, 'v' || pos AS positive_skill_id, sim AS score FROM fs")
def fn_filter_multi(spark, sf):
    return _false_negatives(spark, sf).removed.select("query_id", "skill_id", "positive_skill_id", "score")


@query(f"WITH {_FN} SELECT query_id, 'v' || pool_idx AS skill_id, score FROM top WHERE NOT EXISTS (SELECT 1 FROM fs WHERE fs.query_id = top.query_id AND fs.pool_idx = top.pool_idx)")
def fn_filter(spark, sf):
    return _false_negatives(spark, sf).kept.select("query_id", "skill_id", "score")


@query(f"""WITH {_FN} SELECT 'q' || query_id AS query_id, 'v' || pool_idx AS skill_id, 'semantic' AS source, NULL AS positive_skill_id, score, rank AS position, 'kept' AS scope FROM top WHERE NOT EXISTS (SELECT 1 FROM fs WHERE fs.query_id = top.query_id AND fs.pool_idx = top.pool_idx)
UNION ALL SELECT 'q' || query_id, 'v' || pool_idx, 'semantic', 'v' || pos, sim, NULL, 'semantic_topk' FROM fs""")
def semantic_candidates(spark, sf):
    """Queries with three positives each; what is too similar to one of them goes to review."""
    v, raw = roles.vectors(spark, sf), roles.table(spark, sf, "embeddings")
    n = raw.count()
    spot = lambda step: F.concat(F.lit("v"), ((F.col("vec_id") + step) % n).cast("string"))
    asked = raw.where("vec_id % 10 = 0").select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), "embedding", F.array(spot(0), spot(7), spot(19)).alias("positives"))
    out = negatives.semantic_candidates(asked, v.select("skill_id", "pool_idx", "embedding"), 20, 0.3)
    kept = out.kept.select("query_id", "skill_id", "source", F.lit(None).cast("string").alias("positive_skill_id"), "score", "position", F.lit("kept").alias("scope"))
    return kept.unionByName(out.removed.select("query_id", "skill_id", "source", "positive_skill_id", "score", F.lit(None).cast("long").alias("position"), F.col("filter_scope").alias("scope")))


def _local_queries(spark, sf):
    """Every query with its best lexical match as positive."""
    pool = roles.pool(spark, sf)
    best = _bm25_rank(spark, sf, 1).join(pool.select("pool_idx", "skill_id"), "pool_idx").select("query_id", F.col("skill_id").alias("positive_skill_id"))
    return roles.tasks(spark, sf).join(best, "query_id").select("query_id", "query", "positive_skill_id"), pool


def sql_order(rows: str, n: str, width: int, key: str) -> str:
    """The first ``width`` values of every row's order of 0 .. n - 1, those below n: all columns, position, number."""
    drawn = lambda r, half: f"('0x' || sha256({key} || ':{r}:' || {half})[1:12])::BIGINT"
    at = f"SELECT *, i // b AS l, i % b AS r FROM (SELECT *, unnest(range(0, least({width}, a * b))) AS i FROM (SELECT *, ceil({n} / a)::BIGINT AS b FROM (SELECT *, ceil(sqrt({n}))::BIGINT AS a FROM {rows} x)))"
    for r in range(permutation.ROUNDS):
        at = f"SELECT * REPLACE ({f'(l + {drawn(r, "r")}) % a AS l' if r % 2 == 0 else f'(r + {drawn(r, "l")}) % b AS r'}) FROM ({at})"
    return f"(SELECT * EXCLUDE (a, b, i, l, r), i + 1 AS position, l * b + r AS number FROM ({at}) WHERE l * b + r < {n})"


# Of every list the first 64 candidates, which fill the quotas; pairs are what any scan may look at.
_SEARCH = _BM25.replace(sql_tokens("body"), sql_tokens("concat_ws(chr(10), name, description, body)"))
_LOCAL = f"""first AS (WITH {_BM25} SELECT query_id, pool_idx FROM rk WHERE rank = 1), {_SEARCH}, pl AS (SELECT *, row_number() OVER (ORDER BY category, skill_id) - 1 AS number, row_number() OVER (PARTITION BY category ORDER BY skill_id) - 1 AS mate, count(*) OVER (PARTITION BY category) AS n, count(*) OVER () AS size FROM {POOL}),
best AS (SELECT query_id, skill_id AS positive_skill_id, category, n, size FROM first JOIN pl USING (pool_idx)),
lists AS (SELECT 'bm25' AS source, query_id, skill_id, rank AS position FROM rk JOIN pl USING (pool_idx) WHERE rank <= 64
 UNION ALL SELECT 'same_category', o.query_id, pl.skill_id, o.position FROM {sql_order("best", "n", 64, "'42:' || query_id || ':category:' || category")} o JOIN pl ON pl.category = o.category AND pl.mate = o.number
 UNION ALL SELECT 'random', o.query_id, pl.skill_id, o.position FROM {sql_order("best", "size", 64, "'42:' || query_id || ':random'")} o JOIN pl ON pl.number = o.number),
pairs AS (SELECT DISTINCT query_id, positive_skill_id, skill_id FROM lists JOIN best USING (query_id)), {_REASON.replace(">= 0.6", ">= 0.85")},
fl2 AS (SELECT l.*, f.reason FROM lists l JOIN fl f USING (query_id, skill_id))"""


def _scan(source: str, target: int, seen: str | None) -> str:
    fresh = f" AND (query_id, skill_id) NOT IN (SELECT (query_id, skill_id) FROM {seen})" if seen else ""
    return f"(SELECT source, query_id, skill_id, reason FROM (SELECT *, coalesce(sum((reason IS NULL)::INT) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM fl2 WHERE source = '{source}'{fresh}) WHERE passed < {target})"


@query(f"""WITH {_LOCAL}, s1 AS {_scan("bm25", 3, None)}, s2 AS (SELECT * FROM s1 UNION ALL {_scan("same_category", 2, "s1")}), s3 AS (SELECT * FROM s2 UNION ALL {_scan("random", 1, "s2")})
SELECT query_id, skill_id, source, coalesce(reason, 'negative') AS state FROM s3""")
def local_negatives(spark, sf):
    asked, pool = _local_queries(spark, sf)
    mined = negatives.mine_local(asked, pool, tokenize=TOKENS)
    return mined.negatives.select("query_id", "skill_id", "source", F.lit("negative").alias("state")).unionByName(mined.filtered.select("query_id", "skill_id", "source", F.col("reason").alias("state")))


# Candidates from the ranks of one list: sources by rank modulo 4, so quotas and repeats both occur.
_MERGE_SOURCE = "CASE rank % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'bm25' WHEN 2 THEN 'same_category' ELSE 'random' END"


@query(f"""WITH {_BM25}, mc AS (SELECT query_id, 's' || (pool_idx % 40) AS skill_id, {_MERGE_SOURCE} AS source, rank AS position FROM rk WHERE rank <= 60),
mo AS (SELECT query_id, source, skill_id, min(position) AS position FROM mc WHERE skill_id <> 's7' GROUP BY ALL),
ma AS (SELECT query_id, source, skill_id FROM mo WHERE source = 'semantic' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 4),
mb AS (SELECT query_id, source, skill_id FROM mo WHERE source = 'bm25' AND (query_id, skill_id) NOT IN (SELECT (query_id, skill_id) FROM ma) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 3),
mab AS (SELECT * FROM ma UNION ALL SELECT * FROM mb),
md AS (SELECT query_id, source, skill_id FROM mo WHERE source = 'same_category' AND (query_id, skill_id) NOT IN (SELECT (query_id, skill_id) FROM mab) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 2),
mabd AS (SELECT * FROM mab UNION ALL SELECT * FROM md),
me AS (SELECT query_id, source, skill_id FROM mo WHERE source = 'random' AND (query_id, skill_id) NOT IN (SELECT (query_id, skill_id) FROM mabd) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 1)
SELECT * FROM mabd UNION ALL SELECT * FROM me""")
def merge_sources(spark, sf):
    source = F.when(F.col("rank") % 4 == 0, "semantic").when(F.col("rank") % 4 == 1, "bm25").when(F.col("rank") % 4 == 2, "same_category").otherwise("random")
    c = _bm25_rank(spark, sf, 60).select("query_id", F.concat(F.lit("s"), (F.col("pool_idx") % 40).cast("string")).alias("skill_id"), source.alias("source"), "score", F.col("rank").alias("position"))
    positives = roles.tasks(spark, sf).select("query_id", F.lit("s7").alias("positive_skill_id"))
    return negatives.merge_sources(c, positives).select("query_id", "source", "skill_id")


def _merged(rows: str) -> str:
    """CTEs m0 to m3 and their union: up to each source's quota in order, a skill once, from rows without positives."""
    out, taken = [], []
    for i, (source, quota) in enumerate(negatives.MERGED_SOURCES):
        fresh = "".join(f" AND (query_id, skill_id) NOT IN (SELECT (query_id, skill_id) FROM m{j})" for j in range(i))
        out.append(f"m{i} AS (SELECT query_id, source, skill_id FROM {rows} WHERE source = '{source}'{fresh} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= {quota})")
        taken.append(f"SELECT * FROM m{i}")
    return ", ".join([*out, f"merged AS ({' UNION ALL '.join(taken)})"])


@query(f"""WITH top AS (SELECT query_id, pool_idx, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_idx) AS position FROM (SELECT a.vec_id AS query_id, b.vec_id AS pool_idx, {_SIM} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE position <= 50),
mo AS (SELECT query_id, source, skill_id, min(position) AS position FROM (
  SELECT query_id, pool_idx AS skill_id, 'semantic' AS source, position FROM top UNION ALL SELECT query_id, pool_idx, CASE position % 3 WHEN 0 THEN 'bm25' WHEN 1 THEN 'same_category' ELSE 'random' END, position FROM top WHERE position % 5 = 0) WHERE skill_id <> query_id GROUP BY ALL),
{_merged("mo")}
SELECT 'q' || query_id AS query_id, 'v' || skill_id AS skill_id, CASE WHEN {_SIM} >= 0.3 THEN 'embedding_false_negative' ELSE source END AS state FROM merged JOIN embeddings a ON a.vec_id = skill_id JOIN embeddings b ON b.vec_id = query_id""")
def semantic_negatives(spark, sf):
    v = roles.vectors(spark, sf)
    asked = roles.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), "embedding", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("positive_skill_id"))
    top = dense.semantic_topk(asked.select("query_id", "embedding"), v.select("pool_idx", "embedding"), 50).select("query_id", F.concat(F.lit("v"), F.col("pool_idx").cast("string")).alias("skill_id"), "score", F.col("rank").cast("long").alias("position"))
    local = top.where("position % 5 = 0").withColumn("source", F.when(F.col("position") % 3 == 0, "bm25").when(F.col("position") % 3 == 1, "same_category").otherwise("random"))
    out = negatives.mine_semantic(local, top, asked.select("query_id", "positive_skill_id"), v.select("skill_id", "embedding"), 0.3)
    return out.kept.select("query_id", "skill_id", F.col("source").alias("state")).unionByName(out.removed.select("query_id", "skill_id", F.col("reason").alias("state")))


@query()
def multi_negatives(spark, sf):
    v = roles.vectors(spark, sf).select("skill_id", "embedding", "pool_idx")
    pool = roles.pool(spark, sf).join(v.select("pool_idx", "embedding"), "pool_idx")
    golds = pool.select("skill_id", (F.col("pool_idx") % 20).alias("g"))
    first = golds.groupBy("g").agg(F.min("skill_id").alias("a"))
    both = golds.join(F.broadcast(first), "g").groupBy("g", "a").agg(F.min(F.when(F.col("skill_id") > F.col("a"), F.col("skill_id"))).alias("b"))
    asked = roles.tasks(spark, sf).join(F.broadcast(both), F.col("item_id") % 20 == F.col("g")).select("query_id", "query", F.array_compact(F.array("a", "b")).alias("positives"), "item_id")
    vec = asked.join(v.select("pool_idx", "embedding"), F.col("item_id") == F.col("pool_idx")).select("query_id", "embedding")
    names = pool.select("pool_idx", "skill_id")
    semantic = dense.semantic_topk(vec, pool.select("pool_idx", "embedding"), 64).join(names, "pool_idx").select("query_id", "skill_id", "score", F.col("rank").cast("long").alias("position"))
    out = negatives.mine_multi(asked, pool, semantic, pool.select("skill_id", "embedding"), false_negative=0.35, tokenize=TOKENS)
    return out.negatives.select("query_id", "skill_id", F.col("source").alias("state")).unionByName(out.reviews.select("query_id", "skill_id", F.lit("review").alias("state")))


# ---- compositional graph ----------------------------------------------------------------------------------------------
_STOP = "[" + ", ".join(map(sql_string, ARTIFACT_STOP_WORDS)) + "]"
_FEATURES = f"""w AS (SELECT doc_id, source || '/' || doc_id AS skill_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 8)[1:3] AS made FROM documents),
c AS (SELECT a.doc_id, a.skill_id, array_to_string(a.made, ' ') AS made, coalesce(array_to_string(b.made, ' '), '') AS needed FROM w a LEFT JOIN w b ON b.doc_id = a.doc_id - 1),
el AS (SELECT * FROM c WHERE doc_id % 11 <> 5 AND doc_id % 13 <> 7),
ft AS (SELECT skill_id, doc_id, list_distinct(list_filter({sql_tokens('made')}, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x))) AS o, list_distinct(list_filter({sql_tokens('needed')}, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x))) AS i, list_distinct(list_filter({sql_tokens('needed')}, lambda x: length(x) >= 3)) AS deps FROM el),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(o) AS token FROM ft) GROUP BY 1),
bl AS (SELECT DISTINCT a.skill_id AS s, b.skill_id AS t FROM (SELECT skill_id, unnest(o) AS token FROM ft) a JOIN df ON df.token = a.token AND df.df <= 5 JOIN (SELECT skill_id, unnest(i) AS token FROM ft) b ON b.token = a.token WHERE a.skill_id <> b.skill_id),
mt AS (SELECT bl.s, bl.t, f.doc_id AS sd, g.doc_id AS td, list_intersect(f.o, g.i) AS m, list_intersect(f.o, g.deps) AS md, len(f.o) AS no, len(g.i) AS ni FROM bl JOIN ft f ON f.skill_id = bl.s JOIN ft g ON g.skill_id = bl.t),
ev AS (SELECT *, (len(m) = no AND len(m) = ni) OR (len(m) >= 2 AND len(m) * 2 >= least(no, ni)) OR (len(m) = 1 AND least(no, ni) = 1 AND length(m[1]) >= 4) AS sure FROM mt),
ed AS (SELECT s AS from_skill_id, t AS to_skill_id, CASE WHEN NOT sure THEN 'weak_artifact_handoff' WHEN td % 3 = 0 THEN 'missing_complementary_operation' END AS reason, CASE WHEN sd % 3 = 0 THEN 'producer_to_consumer' ELSE 'artifact_handoff_to_consumer' END AS rel, CASE WHEN sure THEN m ELSE [] END AS m, md FROM ev),
sc AS (SELECT from_skill_id, to_skill_id, rel, round_even(6.0::DOUBLE + (SELECT sum(1.0::DOUBLE / df.df) FROM (SELECT unnest(ed.m) AS token) u JOIN df USING (token)) + 1 + len(md), 6) AS score FROM ed WHERE reason IS NULL),
kp AS (SELECT *, row_number() OVER (PARTITION BY from_skill_id ORDER BY score DESC, to_skill_id) AS nth FROM sc),
tr AS (SELECT a.from_skill_id AS f, a.to_skill_id AS m, b.to_skill_id AS l, round_even(a.score + b.score, 6) AS score FROM kp a JOIN kp b ON b.from_skill_id = a.to_skill_id WHERE a.nth <= 16 AND b.nth <= 16 AND a.from_skill_id <> b.to_skill_id)"""


def _graph(spark, sf):
    none = spark.createDataFrame([], "skill_id string")
    return graph.build(roles.contracts(spark, sf), roles.single_queries(spark, sf), none, tokenize=TOKENS)


@query(f"WITH {_FEATURES} SELECT skill_id, array_to_string(list_sort(o), ' ') AS out_tokens, array_to_string(list_sort(i), ' ') AS in_tokens FROM ft")
def artifact_features(spark, sf):
    f = graph.features(_graph(spark, sf).eligible, TOKENS)
    return f.select("skill_id", F.array_join(F.array_sort("out_tokens"), " ").alias("out_tokens"), F.array_join(F.array_sort("in_tokens"), " ").alias("in_tokens"))


@query(f"WITH {_FEATURES} SELECT from_skill_id, to_skill_id, rel AS operation_relation, score FROM kp WHERE nth <= 16")
def edge_candidates(spark, sf):
    return _graph(spark, sf).edges.select("from_skill_id", "to_skill_id", "operation_relation", "score")


@query(f"WITH {_FEATURES} SELECT 'comp::pair::' || sha256('pair' || chr(0) || from_skill_id || chr(0) || to_skill_id)[1:16] AS candidate_id, from_skill_id AS first, to_skill_id AS second, score, row_number() OVER (ORDER BY score DESC, from_skill_id, to_skill_id) AS rank FROM kp WHERE nth <= 16 QUALIFY rank <= 31977")
def pairs(spark, sf):
    return _graph(spark, sf).pairs.select("candidate_id", F.col("skill_ids")[0].alias("first"), F.col("skill_ids")[1].alias("second"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_FEATURES} SELECT f AS first, m AS second, l AS third, score FROM tr QUALIFY row_number() OVER (ORDER BY score DESC, f, m, l) <= 1000")
def triples(spark, sf):
    return _graph(spark, sf).triples.select(F.col("skill_ids")[0].alias("first"), F.col("skill_ids")[1].alias("second"), F.col("skill_ids")[2].alias("third"), "score")


@query(f"""WITH {_FEATURES} SELECT 'eligibility' AS stage, skill_id AS ids, CASE WHEN doc_id % 11 = 5 THEN 'contract_not_validated' ELSE 'missing_or_stale_single_skill_query' END AS reason FROM c WHERE doc_id % 11 = 5 OR doc_id % 13 = 7
UNION ALL SELECT 'pair_validation', from_skill_id || ' ' || to_skill_id, reason FROM ed WHERE reason IS NOT NULL UNION ALL SELECT 'pair_selection', from_skill_id || ' ' || to_skill_id, 'source_pair_limit' FROM kp WHERE nth > 16
UNION ALL SELECT 'pair_selection', from_skill_id || ' ' || to_skill_id, 'global_pair_limit' FROM (SELECT * FROM kp WHERE nth <= 16 QUALIFY row_number() OVER (ORDER BY score DESC, from_skill_id, to_skill_id) > 31977)
UNION ALL SELECT 'triple_selection', f || ' ' || m || ' ' || l, 'global_triple_limit' FROM (SELECT * FROM tr QUALIFY row_number() OVER (ORDER BY score DESC, f, m, l) > 1000)""")
def rejections(spark, sf):
    return _graph(spark, sf).rejections.select("stage", F.array_join("skill_ids", " ").alias("ids"), F.col("reasons")[0].alias("reason"))


# ---- sampling ---------------------------------------------------------------------------------------------------------
@query(f"SELECT category || '::' || language AS stratum, count(*) AS population FROM (SELECT * FROM {POOL} QUALIFY row_number() OVER (PARTITION BY name, description, body ORDER BY pool_idx) = 1) GROUP BY 1")
def strata_counts(spark, sf):
    rows, _ = sampling.eligible(roles.pool(spark, sf), None)
    return rows.groupBy("stratum").agg(F.count("*").alias("population"))


# The allocation turn by turn: shares by the roots of the populations, whole parts first, then the largest fractions.
@query(f"""WITH RECURSIVE el AS (SELECT *, category || '::' || language AS stratum FROM {POOL} QUALIFY row_number() OVER (PARTITION BY name, description, body ORDER BY pool_idx) = 1),
al AS (SELECT stratum, n, CASE WHEN 120 >= count(*) OVER () THEN 1 ELSE 0 END::BIGINT AS given, 120 - CASE WHEN 120 >= count(*) OVER () THEN count(*) OVER () ELSE 0 END AS rest, 0 AS turn FROM (SELECT stratum, count(*) AS n FROM el GROUP BY 1)
 UNION ALL SELECT stratum, n, given + plus, rest - sum(plus) OVER ()::BIGINT, turn + 1 FROM (
  SELECT *, CASE WHEN given >= n THEN 0 WHEN any_whole THEN whole ELSE (row_number() OVER (PARTITION BY given < n ORDER BY floor(share) - share, stratum) <= rest)::INT END::BIGINT AS plus FROM (
   SELECT *, max(whole) OVER () > 0 AS any_whole FROM (SELECT *, CASE WHEN given < n THEN least(floor(share)::BIGINT, n - given) ELSE 0 END AS whole FROM (
    SELECT *, rest * sqrt(n) / sum(CASE WHEN given < n THEN sqrt(n) END) OVER () AS share FROM al WHERE rest > 0)))))
SELECT skill_id, stratum, row_number() OVER (ORDER BY sha256('42:' || skill_id), skill_id) AS position FROM (
 SELECT el.*, a.given, row_number() OVER (PARTITION BY el.stratum ORDER BY sha256('42:' || el.stratum || ':' || skill_id), skill_id) AS nth FROM el JOIN (SELECT * FROM al WHERE turn = (SELECT max(turn) FROM al)) a ON a.stratum = el.stratum) WHERE nth <= given""")
def stratified_sample(spark, sf):
    return sampling.stratified_sample(roles.pool(spark, sf), 120).records.select("skill_id", "stratum", "position")


# Evenly spaced rows of each type: shares of 20 in proportion, one at least; what is left goes by remainders.
@query(f"""WITH {_FEATURES}, cd AS (SELECT 'pair' AS candidate_type, 'comp::pair::' || sha256('pair' || chr(0) || from_skill_id || chr(0) || to_skill_id)[1:16] AS candidate_id, row_number() OVER (ORDER BY score DESC, from_skill_id, to_skill_id) - 1 AS place FROM kp WHERE nth <= 16 QUALIFY place < 31977
 UNION ALL SELECT 'triple', 'comp::triple::' || sha256('triple' || chr(0) || f || chr(0) || m || chr(0) || l)[1:16], row_number() OVER (ORDER BY score DESC, f, m, l) - 1 AS place FROM tr QUALIFY place < 1000),
pc AS (SELECT candidate_type, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM cd GROUP BY 1),
g0 AS (SELECT *, greatest(1, 20 * n // total) AS g FROM pc), g1 AS (SELECT *, 20 - sum(g) OVER () AS d, row_number() OVER (ORDER BY -(20 * n % total), candidate_type) AS r, row_number() OVER (ORDER BY g DESC, candidate_type DESC) AS top FROM g0),
g2 AS (SELECT *, (CASE WHEN d >= 0 THEN g + (r <= d)::INT ELSE g + CASE WHEN top = 1 THEN d ELSE 0 END END)::BIGINT AS given FROM g1),
pk AS (SELECT *, unnest(range(given)) AS k FROM g2)
SELECT candidate_id, candidate_type FROM cd JOIN (SELECT candidate_type, CASE WHEN given > 1 THEN k * (n - 1) // (given - 1) ELSE 0 END AS place FROM pk) p USING (candidate_type, place)""")
def pilot_selection(spark, sf):
    g = _graph(spark, sf)
    both = cut(g.pairs.unionByName(g.triples))
    numbered = both.withColumn("candidate_idx", F.row_number().over(Window.orderBy("candidate_type", "rank")))
    return sampling.pilot(numbered, 20).select("candidate_id", "candidate_type")
