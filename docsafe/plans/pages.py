"""Queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsafe.functions import decisions as D
from docsafe.functions import text as T
from docsafe.operators import order, rollup
from docsafe.sources import tables
from docsafe.sources.files import upload_error

WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def p5_markdown_to_text(spark: SparkSession, sf: str) -> DataFrame:
    text = T.markdown_to_text(F.col("text"))
    return tables.table(spark, sf, "documents").select("doc_id", text.alias("text")).withColumn("line_count", T.line_count(F.col("text")))


P5 = rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text,
    '(?i)<!--\s*Page\s+\d+\s*-->', '', 'g'), '```[^\n]*\n', '', 'g'), '```', ''), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), '(?m)^#{{1,6}}\s+', '', 'g'),
    '[*_~`]', '', 'g'), '(?m)^\s*[-+]\s+', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: NOT (regexp_full_match(trim(x, {WS}), '\|?[\s:\|-]+\|?') AND contains(x, '-'))) AS l FROM a),
c AS (SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN contains(x, '|') THEN
    array_to_string(list_transform(string_split(trim(trim(x, {WS}), '|'), '|'), lambda y: trim(y, {WS})), chr(9)) ELSE x END), chr(10)) AS t FROM b),
d AS (SELECT doc_id, trim(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) AS text FROM c)
SELECT doc_id, text, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {WS}) <> ''))::BIGINT AS line_count FROM d"""


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents")
    i = F.col("doc_id")
    reason = F.when(i % 10 == 0, F.lit("scanned")).otherwise(F.lit(""))
    reasons = F.when(i % 15 == 0, F.array(F.lit("low_text"), F.lit("images"))).otherwise(F.array().cast("array<string>"))
    where, why = D.route(i % 17 == 0, i % 5 == 0, reason, reasons, F.col("text"), 400)
    return d.select("doc_id", where.alias("route"), why.alias("reason"))


P2 = """SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'fallback' WHEN doc_id % 5 = 0 THEN 'ocr' WHEN n > 0 AND n < 400 THEN 'fallback' ELSE 'native' END AS route,
CASE WHEN doc_id % 17 = 0 THEN 'native_page_missing' WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 'scanned' WHEN doc_id % 15 = 0 THEN 'low_text,images' ELSE 'pdf_inspector_requires_ocr' END
WHEN n > 0 AND n < 400 THEN 'native_text_too_short' END AS reason FROM (SELECT doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS n FROM documents)"""


def p3_fallback_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents")
    i = F.col("doc_id")
    where, why = D.fallback(F.when(i % 13 == 0, F.lit("OSError")), F.col("text"), i % 3 != 0, F.lit("native_page_missing"), 600)
    return d.select("doc_id", where.alias("route"), why.alias("reason"))


P3 = """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'ocr' WHEN n >= 600 OR doc_id % 3 = 0 THEN 'native' ELSE 'ocr' END AS route,
'native_page_missing' || CASE WHEN doc_id % 13 = 0 THEN ';pdfium_text_failure:OSError' WHEN n >= 600 OR doc_id % 3 = 0 THEN '' ELSE ';pdfium_text_missing' END AS reason
FROM (SELECT doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS n FROM documents)"""


def w1_recognition_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents").select((F.col("doc_id") % 16).alias("document"), F.floor(F.col("doc_id") / 16).alias("page_index"), (F.length("text") >= 1500).alias("native"))
    return order.recognition_windows(d).select("document", "page_index", "window_no")


W1 = """WITH p AS (SELECT doc_id % 16 AS document, doc_id // 16 AS page_index, length(text) >= 1500 AS native FROM documents),
i AS (SELECT *, sum(native::INT) OVER (PARTITION BY document ORDER BY page_index) AS island FROM p),
k AS (SELECT *, (row_number() OVER (PARTITION BY document, island ORDER BY page_index) - 1) // 3 AS chunk FROM i WHERE NOT native)
SELECT document, page_index, dense_rank() OVER (PARTITION BY document ORDER BY island, chunk)::BIGINT AS window_no FROM k"""


def s1_upload_check(spark: SparkSession, sf: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 7 == 0, F.lit(b"")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit(b"%PDF-1.7\n"), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    d = tables.table(spark, sf, "documents").select("doc_id", body.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return d.select("doc_id", "length", upload_error(F.col("content"), F.col("length"), 4000).alias("error_code"))


S1 = """SELECT doc_id, n::BIGINT AS length, CASE WHEN n = 0 THEN 'empty_upload' WHEN doc_id % 2 <> 0 THEN 'invalid_pdf' WHEN n > 4000 THEN 'pdf_too_large' END AS error_code
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE strlen(text) + CASE WHEN doc_id % 2 = 0 THEN 9 ELSE 0 END END AS n FROM documents)"""


def s3_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def a21_workload_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    one = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"n_chars":'), F.col("n_chars").cast("string"), F.lit(',"source":"'), F.col("source"), F.lit('"}'))
    return tables.table(spark, sf, "documents").select("doc_id", F.substring(F.sha2(one, 256), 1, 16).alias("fingerprint"))


A21 = """SELECT doc_id, substring(sha256('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"source":"' || source || '"}'), 1, 16) AS fingerprint FROM documents"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    lines = tables.lines(spark, sf).select(F.floor(F.col("doc_id") / 8).alias("document"), (F.col("doc_id") % 8).alias("page_index"), "line_no", "text", "conf")
    return rollup.judged_lines(lines.withColumn("error_code", F.when(F.col("conf") < 0.05, F.lit("decoder_loop_trimmed"))))


JUDGED = f"""{tables.LINES},
chars AS (SELECT doc_id, line_no, i, c, i - row_number() OVER (PARTITION BY doc_id, line_no, c ORDER BY i) AS g FROM (
  SELECT doc_id, line_no, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(lower(text), '')) AS c FROM lines WHERE text <> '') WHERE regexp_full_match(c, '[\\p{{L}}\\p{{N}}_]')),
runs AS (SELECT doc_id, line_no, min(start) AS start FROM (SELECT doc_id, line_no, min(i) AS start FROM chars GROUP BY doc_id, line_no, c, g HAVING count(*) >= 6) GROUP BY ALL),
facts AS (SELECT l.*, trim(text, {WS}) = '' AS empty, r.start IS NOT NULL AS looped, CASE WHEN conf < 0.05 THEN 'decoder_loop_trimmed' END AS error_code FROM lines l LEFT JOIN runs r USING (doc_id, line_no)),
judged AS (SELECT doc_id // 8 AS document, doc_id % 8 AS page_index, line_no, text, conf, error_code,
  CASE WHEN empty OR conf < 0.62 THEN 'high' WHEN looped THEN 'medium' ELSE 'none' END AS risk,
  array_to_string(list_filter([CASE WHEN empty THEN 'empty_primary_text' END, CASE WHEN NOT empty AND conf < 0.62 THEN 'primary_recognition_risk' END, CASE WHEN looped THEN 'decoder_loop' END], lambda x: x IS NOT NULL), ',') AS reasons FROM facts),
safe AS (SELECT *, CASE WHEN risk = 'high' THEN '[OCR_SEMANTIC_RISK page=' || page_index + 1 || ' line=' || line_no + 1 || ' reasons=' || reasons || ']' ELSE text END AS safe_text FROM judged),
paged AS (SELECT document, page_index, coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (trim(text, {WS}) <> ''), '') AS text, string_agg(safe_text, chr(10) ORDER BY line_no) AS safe_text,
  round(avg(conf) FILTER (trim(text, {WS}) <> ''), 4) AS confidence_mean, count(*) AS line_count, count(*) FILTER (risk = 'high') AS risk_count,
  coalesce(bool_or(error_code IS NOT NULL OR risk <> 'none' OR (trim(text, {WS}) <> '' AND conf < 0.8)), false) AS review, bool_or(error_code IS NOT NULL) AS coded FROM safe GROUP BY ALL)"""


def p16_safe_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("document", "page_index", "line_no", "risk", F.array_join("reasons", ",").alias("reasons"), "safe_text")


def a2_page_rollup(spark: SparkSession, sf: str) -> DataFrame:
    p = rollup.pages(_judged(spark, sf))
    return p.select("document", "page_index", F.md5("text").alias("text_md5"), F.md5("safe_text").alias("safe_md5"), "confidence_mean", "line_count", "risk_count", F.array_join("error_codes", ",").alias("error_codes"), "needs_review", "ready")


A2 = f"""WITH {JUDGED} SELECT document, page_index, md5(text) AS text_md5, md5(safe_text) AS safe_md5, confidence_mean, line_count, risk_count,
array_to_string(list_filter([CASE WHEN coded THEN 'decoder_loop_trimmed' END, CASE WHEN text = '' THEN 'empty_ocr_text' END, CASE WHEN risk_count > 0 THEN 'semantic_risk_detected' END], lambda x: x IS NOT NULL), ',') AS error_codes,
review OR text = '' AS needs_review, risk_count = 0 AS ready FROM paged"""


def a4_document_rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = rollup.documents(rollup.pages(_judged(spark, sf)))
    return d.select("document", "page_count", "line_count", "risk_count", "ready", "status", "warnings", F.md5("text").alias("text_md5"), F.md5("safe_text").alias("safe_md5"))


A4 = f"""WITH {JUDGED} SELECT document, count(*) AS page_count, sum(line_count)::BIGINT AS line_count, sum(risk_count)::BIGINT AS risk_count, bool_and(risk_count = 0) AS ready,
CASE WHEN bool_or(coded OR risk_count > 0 OR text = '') THEN 'partial' ELSE 'complete' END AS status, CASE WHEN sum(risk_count) > 0 THEN 'semantic_review_required' ELSE '' END AS warnings,
md5(string_agg('===== Trang ' || page_index + 1 || ' =====' || chr(10) || text, chr(10) || chr(10) ORDER BY page_index)) AS text_md5,
md5(string_agg('===== Trang ' || page_index + 1 || ' =====' || chr(10) || safe_text, chr(10) || chr(10) ORDER BY page_index)) AS safe_md5 FROM paged GROUP BY document"""


def p9_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    return tables.table(spark, sf, "embeddings").select("vec_id", D.quality_action((i % 4 == 3).cast("int") * 90, 800 + i % 500, F.lit(1100).cast("long"), ((i % 25) - 12) / 4).alias("action"), ((i % 1000) / 1e6 < 0.0005).alias("low_ink"))


P9 = """SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN 'rotate_metadata' WHEN 800 + vec_id % 500 > 1100 THEN 'orientation_review' WHEN abs((vec_id % 25 - 12) / 4) <= 1.0 THEN 'keep_original' ELSE 'deskew_required' END AS action,
(vec_id % 1000) / 1e6 < 0.0005 AS low_ink FROM embeddings"""

QUERIES = {
    "p5_markdown_to_text": (p5_markdown_to_text, P5),
    "p2_native_routing": (_routed, P2),
    "p3_fallback_pages": (p3_fallback_pages, P3),
    "w1_recognition_windows": (w1_recognition_windows, W1),
    "s1_upload_check": (s1_upload_check, S1),
    "s3_sha256": (s3_sha256, "SELECT doc_id, sha256(text) AS sha256 FROM documents"),
    "a21_workload_fingerprint": (a21_workload_fingerprint, A21),
    "p16_safe_lines": (p16_safe_lines, f"WITH {JUDGED} SELECT document, page_index, line_no, risk, reasons, safe_text FROM safe"),
    "a2_page_rollup": (a2_page_rollup, A2),
    "a4_document_rollup": (a4_document_rollup, A4),
    "p9_quality_gate": (p9_quality_gate, P9),
}
