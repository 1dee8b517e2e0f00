"""Queries over selections, decisions and accounts. Lines are those of the documents; what an engine would tell of them is
derived from their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsafe.functions import decisions as D
from docsafe.functions import text as T
from docsafe.functions import traces
from docsafe.operators import accounts, selection
from docsafe.sources import tables

KEY = ("doc_id", "line_no")
WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _share(k: int):
    return ((F.col("doc_id") * k + F.col("line_no") * 13) % 100) / 100.0


def share(k: int) -> str:
    return f"((doc_id * {k} + line_no * 13) % 100) / 100.0::DOUBLE"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with reasons, risk and codes."""
    i, n = F.col("doc_id"), F.col("line_no")
    reasons = F.array_compact(F.array(F.when(n % 3 == 0, F.lit("tesseract_numeric_disagreement")), F.when(n % 2 == 0, F.lit("secondary_material_disagreement")), F.when(i % 5 == 0, F.lit("primary_recognition_risk"))))
    risk = F.when(F.col("conf") < 0.3, F.lit("high")).when(F.col("conf") < 0.5, F.lit("medium")).otherwise(F.lit("none"))
    return tables.lines(spark, sf).withColumns({"reasons": reasons, "risk": risk, "error_code": F.when((i + n) % 11 == 0, F.lit("decoder_loop_trimmed"))})


LINED = f"""{tables.LINES}, lined AS (SELECT *, list_filter([CASE WHEN line_no % 3 = 0 THEN 'tesseract_numeric_disagreement' END, CASE WHEN line_no % 2 = 0 THEN 'secondary_material_disagreement' END, CASE WHEN doc_id % 5 = 0 THEN 'primary_recognition_risk' END], lambda x: x IS NOT NULL) AS reasons,
CASE WHEN conf < 0.3 THEN 'high' WHEN conf < 0.5 THEN 'medium' ELSE 'none' END AS risk, CASE WHEN (doc_id + line_no) % 11 = 0 THEN 'decoder_loop_trimmed' END AS error_code FROM lines)"""


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Eight seeds a document, all of them in every seventh, where full coverage is asked for."""
    rows = tables.lines(spark, sf).select(*KEY, F.round(_share(7), 2).alias("score"))
    some, full = selection.seeds(rows.where("doc_id % 7 > 0")), selection.seeds(rows.where("doc_id % 7 = 0"), full=True)
    return some.unionByName(full)


T3 = f"WITH {tables.LINES}, s AS (SELECT doc_id, line_no, round({share(7)}, 2) AS score FROM lines) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no)::INT AS rank FROM s QUALIFY rank <= 8 OR doc_id % 7 = 0"


def remediation(spark: SparkSession, sf: str) -> DataFrame:
    return selection.remediation(_lines(spark, sf)).select(*KEY, "conf", "rank")


T5 = f"WITH {LINED} SELECT doc_id, line_no, conf, row_number() OVER (PARTITION BY doc_id ORDER BY (line_no % 3 <> 0)::INT, conf, line_no)::INT AS rank FROM lined WHERE risk = 'high' QUALIFY rank <= 8"

LABELS = ["chương", "the", "der"]


def _headed(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth line is a heading, half of them a bare label."""
    n = F.col("line_no")
    head = F.when(n % 8 == 0, F.lit("CHƯƠNG ")).when(n % 8 == 4, F.concat(F.lit("Chương  "), F.lit("IV")))
    return _lines(spark, sf).withColumn("text", F.coalesce(head, F.col("text")))


HEADED = f"{LINED}, headed AS (SELECT * REPLACE (CASE WHEN line_no % 8 = 0 THEN 'CHƯƠNG ' WHEN line_no % 8 = 4 THEN 'Chương  IV' ELSE text END AS text) FROM lined)"
BARE = f"lower(rtrim(trim(text, {WS}), '.:;- ')) IN ('chương', 'the', 'der')"
WHOLE = "regexp_full_match(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '(chương|the|der)\\s+([ivxlcdm]{1,8}|\\d{1,4})')"


def heading_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _headed(spark, sf).select(*KEY, D.heading(F.col("text"), LABELS).alias("kind")).where("kind is not null")


P15 = f"WITH {HEADED} SELECT * FROM (SELECT doc_id, line_no, CASE WHEN {BARE} THEN 'incomplete' WHEN {WHOLE} THEN 'complete' END AS kind FROM headed) WHERE kind IS NOT NULL"


def heading_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return selection.headings(_headed(spark, sf), LABELS).select(*KEY, "rank")


T6 = f"WITH {HEADED} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS rank FROM headed WHERE {BARE} QUALIFY rank <= 2"


def refined_headings(spark: SparkSession, sf: str) -> DataFrame:
    """The retry reads a whole heading in two of three documents, with codes and confidences of its own."""
    lines = _headed(spark, sf)
    new = F.when(F.col("doc_id") % 3 == 0, F.lit("Chương ")).otherwise(F.lit("Chương IX"))
    retried = lines.where("doc_id % 10 > 0").select(*KEY, new.alias("new_text"), _share(17).alias("new_conf"), F.when(F.col("doc_id") % 4 == 0, F.lit("recognition_failed")).alias("new_error"))
    out = selection.refined_headings(lines, retried, LABELS)
    return out.select(*KEY, "text", "conf", "error_code", "risk", F.array_join("reasons", ",").alias("reasons"))


D9 = f"""WITH {HEADED}, r AS (SELECT doc_id, line_no, text, conf, error_code, risk, array_to_string(reasons, ',') AS reasons,
  {BARE} AND row_number() OVER (PARTITION BY doc_id, {BARE} ORDER BY line_no) <= 2 AS tried,
  doc_id % 10 > 0 AND doc_id % 3 > 0 AND doc_id % 4 > 0 AND {share(17)} >= greatest(0.45, conf - 0.25) AS good, {share(17)} AS new_conf FROM headed)
SELECT doc_id, line_no, CASE WHEN tried AND good THEN 'Chương IX' ELSE text END AS text, CASE WHEN tried AND good THEN new_conf ELSE conf END AS conf,
 CASE WHEN tried AND good THEN NULL WHEN tried AND error_code IS NULL THEN 'chapter_heading_incomplete' ELSE error_code END AS error_code,
 CASE WHEN tried AND good THEN 'none' WHEN tried AND error_code IS NULL THEN 'high' ELSE risk END AS risk,
 CASE WHEN tried AND good THEN '' WHEN tried AND error_code IS NULL THEN reasons || CASE WHEN reasons = '' THEN '' ELSE ',' END || 'chapter_heading_incomplete' ELSE reasons END AS reasons FROM r"""


def beams(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_no")
    loops = tables.lines(spark, sf).where("line_no % 5 = 0").withColumns({"repeats": 3 + n % 4, "partial": n % 2, "ngram": 1 + n % 3})
    return selection.beams(loops).select(*KEY, "repeats", "partial", "ngram")


T7 = f"WITH {tables.LINES} SELECT doc_id, line_no, 3 + line_no % 4 AS repeats, line_no % 2 AS partial, 1 + line_no % 3 AS ngram FROM lines WHERE line_no % 5 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY 3 + line_no % 4 DESC, line_no % 2 DESC, 1 + line_no % 3 DESC, conf, line_no) = 1"


def tails(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.lines(spark, sf).withColumns({"blank": (F.col("line_no") % 4) / 10.0, "kind": F.lit("tail")})
    risky = tables.lines(spark, sf).withColumn("risk", F.round(_share(19), 1))
    read = selection.tails(rows).select(*KEY, "rank", F.lit("tail").alias("kind"))
    return read.unionByName(selection.guards(risky, 0.5).select(*KEY, "rank", F.lit("guard").alias("kind")))


T8 = f"""WITH {tables.LINES} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no % 4 DESC, conf, line_no DESC)::INT AS rank, 'tail' AS kind FROM lines QUALIFY rank <= 2
UNION ALL SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY risk DESC, line_no)::INT AS rank, 'guard' AS kind FROM (SELECT doc_id, line_no, round({share(19)}, 1) AS risk FROM lines) WHERE risk >= 0.5 QUALIFY rank <= 4"""


def longest_tails(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.lines(spark, sf).select("doc_id", F.col("line_no").alias("place"), (F.col("line_no") % 4).alias("words"), F.round(_share(23), 1).alias("score"))
    return selection.longest_tail(rows, "doc_id")


T11 = f"WITH {tables.LINES} SELECT doc_id, line_no AS place, line_no % 4 AS words, round({share(23)}, 1) AS score FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, score DESC, line_no) = 1"


def cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Blank runs of a projection of ink, the cut in their middle."""
    ink = tables.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v")).select("vec_id", "x", F.abs(F.col("v").cast("double")).alias("ink"))
    blank = ink.where("ink < 0.1").withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy("vec_id").orderBy("x")))
    runs = blank.groupBy("vec_id", "g").agg(F.floor((F.min("x") + F.max("x")) / 2).alias("cut"), F.count("*").alias("run"), F.round(F.avg("ink"), 9).alias("ink"))
    return selection.cut_choice(runs, "vec_id", F.lit(32)).select("vec_id", "cut", "run")


T10 = """WITH e AS (SELECT vec_id, unnest(range(64)) AS x, abs(unnest(embedding)::DOUBLE) AS ink FROM embeddings),
b AS (SELECT *, x - row_number() OVER (PARTITION BY vec_id ORDER BY x) AS g FROM e WHERE ink < 0.1),
r AS (SELECT vec_id, floor((min(x) + max(x)) / 2)::BIGINT AS cut, count(*) AS run, round(avg(ink), 9) AS ink FROM b GROUP BY vec_id, g)
SELECT vec_id, cut, run FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(cut - 32), run DESC, ink, cut) = 1"""

REASONS = {"tesseract_numeric_disagreement": "số khác nhau", "primary_recognition_risk": "nhận dạng rủi ro"}


def review_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).withColumns({"document": F.floor(F.col("doc_id") / 8), "page_index": F.col("doc_id") % 8, "verifier": F.when(F.col("line_no") % 4 > 0, F.reverse("text")), "v_conf": _share(29)})
    return selection.review_list(rows, REASONS)


P18 = f"""WITH {LINED} SELECT doc_id // 8 AS document, doc_id % 8 AS page_index, line_no, format('Trang {{}} · dòng {{}}', doc_id % 8 + 1, line_no + 1) AS heading,
array_to_string(list_transform(reasons, lambda r: CASE r WHEN 'tesseract_numeric_disagreement' THEN 'số khác nhau' WHEN 'primary_recognition_risk' THEN 'nhận dạng rủi ro' ELSE r END), ' · ') AS reasons,
format('OCR chính ({{:.3f}}): {{}}', conf, CASE WHEN text = '' THEN '[trống]' ELSE text END) AS primary,
CASE WHEN line_no % 4 > 0 AND text <> '' THEN format('Tesseract ({{:.3f}}): {{}}', {share(29)}, reverse(text)) ELSE 'Tesseract: không có dòng đối chiếu' END AS verifier FROM lined WHERE risk = 'high'"""


def reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The union of two lists of reasons, what a new reading cannot lift of it, and the higher of two risks."""
    more = F.array_compact(F.array(F.when(F.col("line_no") % 2 == 0, F.lit("empty_primary_text")), F.when(F.col("line_no") % 3 == 0, F.lit("tesseract_numeric_disagreement"))))
    both = D.reason_union(F.col("reasons"), more)
    other = F.when(_share(7) < 0.2, F.lit("high")).when(_share(7) < 0.7, F.lit("medium")).otherwise(F.lit("none"))
    lift = ["tesseract_numeric_disagreement", "secondary_material_disagreement"]
    return _lines(spark, sf).select(*KEY, F.array_join(both, ",").alias("reasons"), F.array_join(D.retained(both, lift), ",").alias("retained"), D.risk_max(F.col("risk"), other).alias("risk"))


A11 = f"""WITH {LINED}, u AS (SELECT *, list_concat(reasons, list_filter([CASE WHEN line_no % 2 = 0 THEN 'empty_primary_text' END, CASE WHEN line_no % 3 = 0 AND NOT list_contains(reasons, 'tesseract_numeric_disagreement') THEN 'tesseract_numeric_disagreement' END], lambda x: x IS NOT NULL)) AS united,
CASE risk WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS a, CASE WHEN {share(7)} < 0.2 THEN 2 WHEN {share(7)} < 0.7 THEN 1 ELSE 0 END AS b FROM lined)
SELECT doc_id, line_no, array_to_string(united, ',') AS reasons, array_to_string(list_filter(united, lambda x: x NOT IN ('tesseract_numeric_disagreement', 'secondary_material_disagreement')), ',') AS retained, ['none', 'medium', 'high'][greatest(a, b) + 1] AS risk FROM u"""


def error_codes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_no")
    code = D.error_code(F.col("text") == "", n % 13 == 0, n % 11 == 0, n % 7 == 0, n % 6 == 0, n % 5 == 0, n % 4 == 0, n % 3 == 0)
    risk, reason = D.deferred_risk(F.lit("none"), code, F.col("conf"))
    return tables.lines(spark, sf).select(*KEY, code.alias("code"), risk.alias("risk"), reason.alias("reason"))


D10 = f"""WITH {tables.LINES}, c AS (SELECT doc_id, line_no, conf, CASE WHEN text = '' THEN 'recognition_failed' WHEN line_no % 13 = 0 THEN 'numeric_ocr_pattern_unresolved' WHEN line_no % 11 = 0 THEN 'decoder_attention_span_trimmed'
 WHEN line_no % 7 = 0 THEN 'decoder_loop_trimmed' WHEN line_no % 6 = 0 THEN 'unsupported_ocr_insertion_removed' WHEN line_no % 5 = 0 THEN 'tail_segment_suppressed' WHEN line_no % 4 = 0 THEN 'tail_segment_uncertain' WHEN line_no % 3 = 0 THEN 'width_cap_unresolved' END AS code FROM lines)
SELECT doc_id, line_no, code, CASE WHEN code IS NOT NULL OR conf < 0.62 THEN 'high' ELSE 'none' END AS risk, CASE WHEN code IS NOT NULL OR conf < 0.62 THEN 'primary_recognition_risk' END AS reason FROM c"""


def primary_risk(spark: SparkSession, sf: str) -> DataFrame:
    """The rules before readings are compared; compare where they leave it to the comparison."""
    second = F.when(F.col("line_no") % 3 > 0, F.col("text"))
    risk, why = D.semantic_decision(F.col("text"), F.col("conf"), F.col("error_code"), second, 0.8 + _share(11) / 5)
    return _lines(spark, sf).select(*KEY, F.coalesce(risk, F.lit("compare")).alias("risk"), why.alias("reason"))


D3 = f"""WITH {LINED}, s AS (SELECT *, trim(text) = '' AS blank, error_code IS NOT NULL OR conf < 0.62 AS risky, line_no % 3 = 0 AS missing, 0.8 + {share(11)} / 5 < 0.90 AS weak FROM lined)
SELECT doc_id, line_no, CASE WHEN blank THEN 'high' WHEN (missing OR weak) AND risky THEN 'high' WHEN missing OR weak THEN 'none' ELSE 'compare' END AS risk,
CASE WHEN blank THEN 'empty_primary_text' WHEN (missing OR weak) AND risky THEN CASE WHEN missing THEN 'secondary_unavailable' ELSE 'secondary_low_confidence' END END AS reason FROM s"""


def beam_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    retried = F.when(F.col("line_no") % 4 == 0, F.lit("")).otherwise(F.left("text", F.floor(F.length("text") * _share(7)).cast("int")))
    return tables.lines(spark, sf).select(*KEY, D.beam_accepted(retried, F.col("text"), F.col("line_no") % 7 == 0).alias("accepted"))


D18 = f"""WITH {tables.LINES}, r AS (SELECT *, CASE WHEN line_no % 4 = 0 THEN '' ELSE left(text, floor(length(text) * {share(7)})::INT) END AS retried FROM lines)
SELECT doc_id, line_no, trim(retried, {WS}) <> '' AND line_no % 7 <> 0 AND length(retried) >= ceil(0.45::DOUBLE * length(text)) AS accepted FROM r"""


def evidence_score(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_no")
    score = D.candidate_score(n % 2 == 0, n % 3 == 0, F.col("conf"), n % 7 == 0, n % 5 == 0, _share(7) / 4, _share(11) / 3)
    return tables.lines(spark, sf).select(*KEY, F.round(score, 6).alias("score"), (score >= 0.38).alias("selected"))


N13 = f"""WITH {tables.LINES}, s AS (SELECT doc_id, line_no, least(1.0::DOUBLE, CASE WHEN line_no % 2 = 0 THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN line_no % 3 = 0 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN conf < 0.72 THEN least(0.28::DOUBLE, 0.72::DOUBLE - conf + 0.08::DOUBLE) ELSE 0 END
 + CASE WHEN line_no % 7 = 0 THEN 0.42::DOUBLE ELSE 0 END + CASE WHEN line_no % 5 = 0 THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN {share(7)} / 4 >= 0.12 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN {share(11)} / 3 > 0.20 THEN 0.18::DOUBLE ELSE 0 END) AS score FROM lines)
SELECT doc_id, line_no, round(score, 6) AS score, score >= 0.38::DOUBLE AS selected FROM s"""


def trace_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Centres of a segment on its line, and a metric filled up to the length of the trace."""
    e = tables.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    width = (64 + F.col("vec_id") % 7 * 8).cast("double")
    centres = traces.global_centres(F.col("v"), width, F.lit(2.0), F.lit(10.0), width - 4, F.lit(160.0))
    filled = traces.padded(F.col("v"), (40 + F.col("vec_id") % 50).cast("int"), 0.5)
    return e.select("vec_id", F.round(traces.total(centres), 6).alias("centres"), F.size(filled).cast("long").alias("n"), F.round(traces.total(filled), 6).alias("total"))


N8 = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v, (64 + vec_id % 7 * 8)::DOUBLE AS w, 40 + vec_id % 50 AS n FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: least(1.0, greatest(0.0, (10.0 + least(greatest(x * w - 2.0, 0.0), w - 4)) / 160.0)))), 6) AS centres, n AS n, round(CASE WHEN n <= 64 THEN list_sum(v[1:n]) ELSE 0.5 * n END, 6) AS total FROM e"""


def page_totals(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    metrics = F.map_from_arrays(F.array(*[F.lit(x) for x in ("recognition_ms", "line_detection_ms", "recognition_window_ms", "line_count", "render_ms_total")]), F.array(F.round(v, 3), F.round(v / 2, 3), v * 3, F.lit(7.0), v))
    return tables.table(spark, sf, "events").select("event_id", accounts.page_total(metrics).alias("page_total_ms"))


A3 = "SELECT event_id, round(round(value, 3) + round(value / 2, 3), 3) AS page_total_ms FROM events"


def accounted(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").withColumn("batch", F.floor(F.col("event_id") / 8))
    stage = lambda k: F.sum(F.when(F.col("event_id") % 8 == k, F.round("value", 2)))
    sums = e.groupBy("batch").agg(F.max(F.col("value") * 3).alias("wall"), F.max("value").alias("cpu"), *[stage(k).alias(name) for k, name in enumerate(accounts.STAGES)])
    return sums.select("batch", *[c.alias(k) for k, c in accounts.accounted(F.col("wall"), F.col("cpu"), F.lit(1.5), *[F.col(s) for s in accounts.STAGES]).items()])


A25 = """WITH s AS (SELECT event_id // 8 AS batch, max(value * 3) AS wall, max(value) AS cpu, sum(round(value, 2)) AS t FROM events GROUP BY 1)
SELECT batch, round(cpu / greatest(wall, 1e-9), 4) AS cpu_wall_ratio, round(t + 1.5, 3) AS accounted_wall_ms, round(greatest(0.0, wall - t - 1.5), 3) AS unaccounted_wall_ms FROM s"""


def counters(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_no")
    rows = _lines(spark, sf).withColumns({"document": F.floor(F.col("doc_id") / 8), "page_index": F.col("doc_id") % 8, "candidate": n % 3 > 0, "verified": n % 4 == 0, "unavailable": n % 5 == 0, "trimmed": n % 7 == 0, "eligible": n % 2 == 0, "attempted": n % 6 == 0, "applied": F.when(n % 2 == 0, n % 12 == 0)})
    return accounts.semantic_counters(rows)


A24 = f"""WITH {LINED} SELECT doc_id // 8 AS document, doc_id % 8 AS page_index, count(*) FILTER (line_no % 3 > 0) AS candidate_count, count(*) FILTER (line_no % 3 = 0) AS skipped_count, count(*) FILTER (line_no % 4 = 0) AS verified_count,
count(*) FILTER (line_no % 5 = 0) AS secondary_unavailable_count, count(*) FILTER (line_no % 7 = 0) AS auto_trimmed_count, count(*) FILTER (risk = 'high') AS high_risk_count, count(*) FILTER (line_no % 2 = 0) AS retry_eligible_count,
count(*) FILTER (line_no % 6 = 0) AS retry_attempted_count, count(*) FILTER (line_no % 12 = 0) AS retry_applied_count FROM lined GROUP BY 1, 2"""


def line_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of a line are the four lines of a group; every sixth has lost its text."""
    rows = tables.lines(spark, sf).select("doc_id", F.floor(F.col("line_no") / 4).alias("line"), F.when(F.col("line_no") % 6 < 4, F.lit("")).otherwise(F.col("text")).alias("text"), F.col("conf").alias("p"))
    return accounts.line_confidence(rows, ["doc_id", "line"])


A13 = f"WITH {tables.LINES} SELECT doc_id, (line_no // 4)::BIGINT AS line, coalesce(min(conf) FILTER (line_no % 6 >= 4 AND text <> ''), 0.0) AS confidence FROM lines GROUP BY 1, 2"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 8).alias("document"), (F.col("doc_id") % 8).alias("page_index"), "doc_id", "text")


def missing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages of a document against those that an extractor gave; what it did not give falls back."""
    p = _pages(spark, sf)
    every = p.groupBy("document").agg(F.max("page_index").alias("n")).select("document", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("page_index"))
    given = p.where("doc_id % 17 > 0").select("document", "page_index", "text")
    out = every.join(given, ["document", "page_index"], "left")
    route, reason = D.route(F.col("text").isNull(), F.lit(False), F.lit(""), F.array().cast("array<string>"), F.col("text"), 400)
    return out.select("document", "page_index", route.alias("route"), reason.alias("reason"))


J1 = f"""WITH p AS (SELECT doc_id // 8 AS document, doc_id % 8 AS page_index, doc_id, text FROM documents), every AS (SELECT document, unnest(range(max(page_index) + 1)) AS page_index FROM p GROUP BY document),
j AS (SELECT e.document, e.page_index, length(trim(g.text, {WS})) AS n FROM every e LEFT JOIN (SELECT * FROM p WHERE doc_id % 17 > 0) g ON e.document = g.document AND e.page_index = g.page_index)
SELECT document, page_index, CASE WHEN n IS NULL OR (n > 0 AND n < 400) THEN 'fallback' ELSE 'native' END AS route, CASE WHEN n IS NULL THEN 'native_page_missing' WHEN n > 0 AND n < 400 THEN 'native_text_too_short' END AS reason FROM j"""


def all_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Native pages, read pages and pages without ink as one table."""
    p = _pages(spark, sf)
    native = p.where("length(text) >= 1500").select("document", "page_index", F.lit("native").alias("source"), F.md5("text").alias("text"), F.md5("text").alias("safe_text"))
    bare = p.where("length(text) < 1500 and doc_id % 9 = 0")
    early = accounts.low_ink_pages(bare.select(F.col("doc_id").alias("page_index"), F.lit(None).cast("string").alias("reason")))
    early = early.select(F.floor(F.col("page_index") / 8).alias("document"), (F.col("page_index") % 8).alias("page_index"), F.lit("early").alias("source"), "text", "safe_text")
    read = p.where("length(text) < 1500 and doc_id % 9 > 0").select("document", "page_index", F.lit("ocr").alias("source"), F.md5("text").alias("text"), F.md5(F.reverse("text")).alias("safe_text"))
    return native.unionByName(read).unionByName(early)


U7 = """SELECT doc_id // 8 AS document, doc_id % 8 AS page_index, CASE WHEN length(text) >= 1500 THEN 'native' WHEN doc_id % 9 = 0 THEN 'early' ELSE 'ocr' END AS source,
CASE WHEN length(text) >= 1500 OR doc_id % 9 > 0 THEN md5(text) ELSE '' END AS text,
CASE WHEN length(text) >= 1500 THEN md5(text) WHEN doc_id % 9 = 0 THEN '[OCR_SEMANTIC_RISK page=' || doc_id + 1 || ' line=0 reasons=empty_ocr_text,low_ink_page]' ELSE md5(reverse(text)) END AS safe_text FROM documents"""


def early_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).where("doc_id % 4 = 0").select(F.col("doc_id").alias("page_index"), F.when(F.col("doc_id") % 8 == 0, F.lit("scanned")).alias("reason"))
    out = accounts.low_ink_pages(p)
    return out.withColumns({"error_codes": F.array_join("error_codes", ","), "reasons": F.array_join("reasons", ",")})


P11 = """SELECT doc_id AS page_index, '' AS text, '[OCR_SEMANTIC_RISK page=' || doc_id + 1 || ' line=0 reasons=empty_ocr_text,low_ink_page]' AS safe_text, CASE WHEN doc_id % 8 = 0 THEN 'scanned' ELSE 'low_ink' END AS reason, 0::BIGINT AS line_count, 1::BIGINT AS risk_count,
'empty_ocr_text' AS error_codes, 'empty_ocr_text,low_ink_page' AS reasons, true AS needs_review, false AS ready FROM documents WHERE doc_id % 4 = 0"""


def failure_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of documents whose extractor failed or is switched off, by the three policies in turn."""
    i = F.col("document")
    error = F.when(i % 3 > 0, F.concat(F.lit("ValueError:page "), i.cast("string")))
    p = _pages(spark, sf)
    out = D.failed_extraction(i % 5 > 0, error, F.when(i % 2 == 0, F.lit("pdfium_then_ocr")).otherwise(F.lit("ocr_all")), F.col("text"), F.col("doc_id") % 3 > 0, 600)
    return p.select("document", "page_index", out[0].alias("route"), out[1].alias("reason"))


P4 = f"""WITH p AS (SELECT doc_id, doc_id // 8 AS document, doc_id % 8 AS page_index, length(trim(text, {WS})) AS n FROM documents), q AS (SELECT *, 'native_failure:ValueError:page ' || document AS failure FROM p)
SELECT document, page_index, CASE WHEN document % 5 = 0 THEN 'ocr' WHEN document % 3 = 0 THEN NULL WHEN document % 2 = 1 THEN 'ocr' WHEN n >= 600 OR doc_id % 3 = 0 THEN 'native' ELSE 'ocr' END AS route,
CASE WHEN document % 5 = 0 THEN 'native_pdf_disabled' WHEN document % 3 = 0 THEN NULL WHEN document % 2 = 1 THEN failure WHEN n >= 600 OR doc_id % 3 = 0 THEN NULL ELSE failure || ';pdfium_text_missing' END AS reason FROM q"""


def secondary_values(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with the secondary reading of their place, where there is one."""
    lines = tables.lines(spark, sf)
    second = lines.where("doc_id % 3 > 0 and line_no % 4 > 0").select(*KEY, F.md5(F.lower("text")).alias("secondary"), (0.5 + _share(7) / 2).alias("s_conf"))
    return lines.select(*KEY).join(second, list(KEY), "left")


J3 = f"""WITH {tables.LINES}, s AS (SELECT doc_id, line_no, md5(lower(text)) AS secondary, 0.5 + {share(7)} / 2 AS s_conf FROM lines WHERE doc_id % 3 > 0 AND line_no % 4 > 0)
SELECT doc_id, line_no, secondary, s_conf FROM lines LEFT JOIN s USING (doc_id, line_no)"""


def segment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy("line_no")
    return tables.lines(spark, sf).withColumns({"right": F.lead("line_no").over(by), "n": F.length("text") + F.lead(F.length("text")).over(by)}).where("right is not null").select(*KEY, "right", "n")


J7 = f"WITH {tables.LINES} SELECT a.doc_id, a.line_no, b.line_no AS right, (length(a.text) + length(b.text))::INT AS n FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 1"


def trace_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Traces and segments of one place; the texts of every fifth differ by more than blanks, and are counted."""
    lines = tables.lines(spark, sf)
    traced = lines.where("line_no % 2 = 0").select(*KEY, F.when(F.col("line_no") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.concat(F.lit("  "), "text", F.lit("  "))).alias("raw"))
    same = T.normalized(F.col("raw")) == T.normalized(F.col("text"))
    return lines.join(traced, list(KEY)).groupBy("doc_id").agg(F.count_if(same).alias("matched"), F.count_if(~same).alias("mismatched"))


J10 = f"""WITH {tables.LINES} SELECT doc_id, count(*) FILTER (line_no % 5 <> 0) AS matched, count(*) FILTER (line_no % 5 = 0) AS mismatched FROM lines WHERE line_no % 2 = 0 GROUP BY doc_id"""


def bounded_events(spark: SparkSession, sf: str) -> DataFrame:
    """The last events of each kind of a user, as many as its list holds."""
    most = F.when(F.col("event_type") == "view", 5).when(F.col("event_type") == "error", 2).otherwise(1)
    by = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return tables.table(spark, sf, "events").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).select("user_id", "event_type", "event_id", "rank")


T12 = "SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events QUALIFY rank <= CASE event_type WHEN 'view' THEN 5 WHEN 'error' THEN 2 ELSE 1 END"


def report(spark: SparkSession, sf: str) -> DataFrame:
    return accounts.report(tables.table(spark, sf, "events"))


K4 = """WITH s AS (SELECT event_type, count(*)::DOUBLE AS c, avg(value) AS m, max(value) AS x FROM events GROUP BY event_type)
SELECT 'stages' AS section, event_type AS key, 'count' AS stat, round(c, 4) AS value FROM s UNION ALL SELECT 'stages', event_type, 'mean', round(m, 4) FROM s UNION ALL SELECT 'stages', event_type, 'max', round(x, 4) FROM s"""

QUERIES = {
    "t3_seed_coverage": (seeds, T3),
    "t5_remediation": (remediation, T5),
    "p15_heading_kinds": (heading_kinds, P15),
    "t6_heading_retry": (heading_seeds, T6),
    "d9_heading_refine": (refined_headings, D9),
    "t7_beam_retry": (beams, T7),
    "t8_tail_and_guard_retry": (tails, T8),
    "t11_longest_tail": (longest_tails, T11),
    "t10_cut_choice": (cuts, T10),
    "p18_review_list": (review_list, P18),
    "a11_a12_p21_u6_reasons": (reasons, A11),
    "d10_d11_error_codes": (error_codes, D10),
    "d3_primary_risk": (primary_risk, D3),
    "d18_beam_acceptance": (beam_acceptance, D18),
    "n13_evidence_score": (evidence_score, N13),
    "n8_n11_trace_arrays": (trace_arrays, N8),
    "a3_page_total": (page_totals, A3),
    "a25_accounted_time": (accounted, A25),
    "a24_semantic_counters": (counters, A24),
    "a13_line_confidence": (line_confidence, A13),
    "j1_missing_pages": (missing_pages, J1),
    "u7_all_pages": (all_pages, U7),
    "p11_early_pages": (early_pages, P11),
    "p4_failure_policy": (failure_policy, P4),
    "j3_secondary_values": (secondary_values, J3),
    "j7_segment_pairs": (segment_pairs, J7),
    "j10_trace_matches": (trace_matches, J10),
    "t12_bounded_events": (bounded_events, T12),
    "k4_report": (report, K4),
}
