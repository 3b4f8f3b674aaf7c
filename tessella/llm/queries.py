"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe_sql, decontam, exact_dedup, fim, html_extract, jaccard_join, langid, license_scan, pii, sale_versions, simhash, token_counts, token_files
from tessella.llm.common import StageTables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_sql.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = StageTables(spark, "token-files").path("out")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out, end_id=2)
    return token_files.read_token_files(spark, out, with_ids=False)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(_table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.mask(_table(spark, sf_dir, "documents"), key="registered query")
    return out.select("doc_id", "text", "n_pii", F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",").alias("kinds"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(_table(spark, sf_dir, "documents"), jaccard_join.Rule(k=3, num=90, den=100))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()), F.col("lang"))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored("output", "form"), 256).alias("restored_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_sale_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, changes = _table(spark, sf_dir, "sales"), _table(spark, sf_dir, "client_changes").where("valid_at is not null").distinct()
    day = lambda x: sale_versions.day(F.col(x))
    sales = sales.withColumn("batch", sale_versions.batch_of_day(day("arrived_at"), 12, 19723, 152))
    changes = changes.withColumn("batch", sale_versions.batch_of_day(day("valid_at") + F.crc32(F.col("change_id").cast("string")) % 4, 12, 19723, 152))
    return sale_versions.enrich(sales, changes, 12)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_bpe, op3_exact_dedup, op4_token_files, op5_license_scan, op6_decontamination, op7_token_counts, op8_pii, op9_jaccard_join, op10_language_id, op11_fill_in_middle, op12_simhash, op13_sale_versions, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d),
        f AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q,
            CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        o AS (SELECT *, substring(text, 1, p) AS x, substring(text, p + 1, q - p) AS y, substring(text, q + 1) AS z FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM o""",
    # Of every batch W (the changes' watermark) and H; of every version the batch after which it is gone: the first by
    # which a later version at or before H is there. CRC-32 bit by bit, as the SQL has no function for it.
    "op13_sale_versions": """
        WITH c0 AS (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL),
        c1 AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(change_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) AS crc FROM c0),
        c AS (SELECT *, greatest(0, least(11, floor((date_diff('day', DATE '1970-01-01', valid_at::DATE) + coalesce(crc % 4, 0) - 19723) * 12 / 152)))::BIGINT AS a FROM c1),
        s AS (SELECT *, row_number() OVER () AS rowid_, greatest(0, least(11, coalesce(floor((date_diff('day', DATE '1970-01-01', arrived_at::DATE) - 19723) * 12 / 152), 11)))::BIGINT AS a FROM sales),
        w AS (SELECT b, (SELECT max(valid_at) FROM c WHERE a < b) AS wc, (SELECT max(sold_at) FROM s WHERE a < b) AS ws FROM range(13) t(b)),
        h AS (SELECT b, wc, CASE WHEN wc IS NOT NULL AND ws IS NOT NULL THEN least(wc, ws) END AS h FROM w),
        v1 AS (SELECT c.*, (SELECT min(h.b) FROM h WHERE h.b >= c.a AND c.valid_at <= h.h) AS old FROM c JOIN h ON h.b = c.a WHERE h.wc IS NULL OR c.valid_at >= h.wc),
        v AS (SELECT *, min(old) OVER (PARTITION BY client_id ORDER BY valid_at, change_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM v1),
        v2 AS (SELECT * REPLACE (CASE WHEN later IS NULL THEN 99 ELSE greatest(a, later) END AS later) FROM v),
        e AS (SELECT s.*, coalesce((SELECT min(h.b) FROM h WHERE h.b >= s.a AND (s.sold_at IS NULL OR s.sold_at < h.h)), 12) AS e FROM s),
        f AS (SELECT e.sale_id, e.e, count(v2.client_id) AS n_held,
            arg_max({'change_id': v2.change_id, 'balance': v2.balance, 'op': v2.op}, (v2.valid_at, v2.change_id)) FILTER (v2.valid_at <= e.sold_at) AS r
            FROM e LEFT JOIN v2 ON e.client_id = v2.client_id AND v2.a <= e.e AND v2.later >= e.e GROUP BY e.rowid_, e.sale_id, e.e)
        SELECT 'sale' AS rec, sale_id AS id, e AS batch, n_held, r.change_id AS change_id, floor(100 * r.balance + 0.5)::BIGINT AS balance_cents, r.op AS op FROM f
        UNION ALL SELECT 'late', change_id, a, NULL, NULL, NULL, NULL FROM c JOIN h ON h.b = c.a WHERE c.valid_at < h.wc""",
}
