"""Queries over several readings of a line. Lines of documents as printed are one, the others are derived from it: the
verifier reads without accents in every third document and joins the first two words in every fifth, the secondary
reading is lower case and lacks the last three words of every fourth document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsafe.functions import decisions as D
from docsafe.functions import readings as R
from docsafe.functions import text as T
from docsafe.functions import traces
from docsafe.operators import semantic
from docsafe.sources import tables

KEY = ("doc_id", "line_no")
W = r"[\p{L}\p{N}_]"


def readings(spark: SparkSession, sf: str) -> DataFrame:
    t, i = F.col("text"), F.col("doc_id")
    plain = F.translate(t, "".join(T.PLAIN), "".join(T.PLAIN.values()))
    verifier = F.when(i % 3 == 0, plain).when(i % 5 == 0, F.regexp_replace(t, rf"^({W}+) ", "$1")).otherwise(t)
    secondary = F.when(i % 4 == 0, F.regexp_replace(F.lower(t), r"(?:\s+\S+){3}$", "")).otherwise(F.lower(t))
    share = lambda k: ((i * k + F.col("line_no") * 13) % 100) / 100.0
    return tables.printed(spark, sf).select(*KEY, "text", "conf", verifier.alias("verifier"), (0.8 + share(7) / 5).alias("v_conf"), secondary.alias("secondary"), (0.85 + share(11) / 7).alias("s_conf"))


def sequence_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).select(*KEY, F.round(R.similarity("text", "verifier"), 6).alias("verifier_ratio"), F.round(R.similarity("text", "secondary"), 6).alias("secondary_ratio"))


def token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    a = readings(spark, sf).select(*KEY, R.alignment("text", "verifier").alias("a"), F.size(T.retry_tokens(F.col("text"))).alias("n"))
    return a.select(*KEY, F.size("a").cast("long").alias("aligned"), F.col("n").cast("long").alias("n"))


def three_engine_separators(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf).withColumn("verifier", F.regexp_replace("verifier", ", ", "; ")).withColumn("secondary", F.regexp_replace("secondary", ", ", "; "))
    return r.select(*KEY, R.separators("text", "verifier", "secondary").alias("text"))


def legal_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return tables.printed(spark, sf).select(*KEY, R.legal_phrases(F.concat(F.lit("tai thành viên bồ sung "), "text")).alias("text"))


def verifier_decision(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf)
    reason = D.verified(R.disagreement("text", "verifier"), F.col("v_conf"), F.col("doc_id") % 17 > 0)
    return r.select(*KEY, reason.alias("reason"), F.when(reason.isNotNull(), F.lit("high")).otherwise(F.lit("none")).alias("risk"))


def semantic_decision(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf).withColumn("c", R.comparison("text", "secondary"))
    first, why = D.semantic_decision(F.col("text"), F.col("conf"), F.lit(None).cast("string"), F.col("secondary"), F.col("s_conf"))
    then, because = D.compared_decision(F.col("c"), F.col("conf") < 0.62)
    decided = first.isNotNull()
    out = r.select(*KEY, "text", "c.prefix", F.coalesce(first, then).alias("risk"), F.when(decided, why).otherwise(because).alias("reason"))
    return out.select(*KEY, "risk", "reason", F.when(F.col("reason") == "unsupported_suffix_removed", F.col("prefix")).otherwise(F.col("text")).alias("text"))


def verifier_consensus(spark: SparkSession, sf: str) -> DataFrame:
    c = readings(spark, sf).select(*KEY, R.consensus("text", "verifier", "v_conf", "secondary", "s_conf").alias("c"))
    return c.select(*KEY, "c.text", "c.applied", "c.reason")


def consensus_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Two variants: the verifier's words and the secondary's, read at two widths."""
    one = lambda t, c, w: F.struct(F.col(t).alias("text"), F.col(c).alias("confidence"), F.lit(w).cast("long").alias("width"))
    r = readings(spark, sf).withColumn("xs", F.array(one("verifier", "v_conf", 288), one("secondary", "s_conf", 320)))
    c = r.select(*KEY, R.retry("text", "verifier", "v_conf", "secondary", "s_conf", "xs").alias("c"))
    return c.select(*KEY, "c.text", "c.applied", "c.reason", "c.width")


def _variants(r: DataFrame) -> DataFrame:
    one = lambda t, c, w: F.struct(F.col(t).alias("text"), F.col(c).alias("confidence"), F.lit(w).cast("long").alias("width"))
    return r.select(*KEY, F.array(one("verifier", "v_conf", 288), one("secondary", "s_conf", 320)).alias("variants"))


def _judged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with codes, risks and reasons; the second recogniser gives nothing for every 13th document."""
    i, n = F.col("doc_id"), F.col("line_no")
    r = readings(spark, sf).withColumns({
        "error_code": F.when((i + n) % 11 == 0, F.lit("decoder_loop_trimmed")), "risk": F.when(n % 4 == 0, F.lit("high")).otherwise(F.lit("none")),
        "reasons": F.array_compact(F.array(F.when(n % 4 == 0, F.lit("tesseract_material_disagreement")))),
    })
    r = semantic.candidates(r)
    here = F.col("candidate") & (i % 13 > 0)
    return r.withColumns({c: F.when(here, F.col(c)) for c in ("secondary", "s_conf")})


def semantic_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Every line through consensus, retry and decision; a document is a page."""
    out = semantic.verified(semantic.prepared(_judged_lines(spark, sf), ["doc_id"]), ["doc_id"], _variants(readings(spark, sf)))
    return out.select(*KEY, "text", "raw_text", F.round("conf", 6).alias("conf"), "error_code", "risk", F.array_join("reasons", ",").alias("reasons"), "retry_reason", "applied", "trimmed")


def remediation_flow(spark: SparkSession, sf: str) -> DataFrame:
    """The last attempt at high risks, with the verifier's reading of single lines in nine of ten documents."""
    again = readings(spark, sf).withColumn("verifier", F.when(F.col("doc_id") % 10 > 0, F.col("text"))).join(_variants(readings(spark, sf)), list(KEY))
    lines = _judged_lines(spark, sf).withColumns({"text": F.regexp_replace("text", r"\w(?=\s)", ""), "raw_text": F.lit(None).cast("string")})
    out = semantic.remediated(lines, ["doc_id"], again)
    return out.select(*KEY, "text", F.round("conf", 6).alias("conf"), "error_code", "risk", F.array_join("reasons", ",").alias("reasons"), "selected", "attempted", "applied")


def delete_only(spark: SparkSession, sf: str) -> DataFrame:
    c = readings(spark, sf).select(*KEY, R.deletion("text", "secondary", "conf", "s_conf", F.lit(0.0), F.lit(0.2), F.lit(0.2)).alias("c"))
    return c.where("c is not null and c.mode is not null").select(*KEY, "c.text", F.size("c.removed").cast("long").alias("removed"), "c.mode", "c.numeric_warning")


def near_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return tables.printed(spark, sf).select(*KEY, R.near_repeat("text").alias("start"))


def retry_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The four lines of a document that a retry tries first."""
    r = readings(spark, sf).withColumn("reason", F.when(F.col("doc_id") % 3 == 0, F.lit("tesseract_material_disagreement")).when(F.col("line_no") % 2 == 0, F.lit("tesseract_numeric_disagreement")))
    score = D.retry_priority(F.array_compact(F.array("reason")), F.when(F.col("conf") < 0.1, F.lit("decoder_loop_trimmed")), F.col("conf"))
    ranked = r.select(*KEY, F.round(score, 6).alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "line_no")))
    return ranked.where("rank <= 4")


T4 = f"""WITH {tables.PRINTED}, s AS (SELECT doc_id, line_no, round(CASE WHEN doc_id % 3 = 0 THEN 180.0::DOUBLE WHEN line_no % 2 = 0 THEN 300.0::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN conf < 0.1 THEN 260.0::DOUBLE ELSE 0.0::DOUBLE END + greatest(0.0, 1.0 - conf) * 10.0, 6) AS score FROM lines)
SELECT doc_id, line_no, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no)::INT AS rank FROM s QUALIFY rank <= 4"""


def selective(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf)
    holds = D.needs_verification(F.lit(None).cast("string"), F.col("conf"), F.lit("none"), F.col("text"), F.lit(None).cast("string"))
    return r.where(holds).groupBy("doc_id").agg(F.count("*").alias("candidates"))


P14 = f"""WITH {tables.PRINTED} SELECT doc_id, count(*) AS candidates FROM lines WHERE conf < 0.62 OR regexp_matches(text, '\\p{{Nd}}') GROUP BY doc_id"""


def tails(spark: SparkSession, sf: str) -> DataFrame:
    ink = ((F.col("doc_id") + F.col("line_no")) % 5) / 200.0
    blank = (F.col("line_no") % 10) / 20.0
    return tables.printed(spark, sf).select(*KEY, D.tail_decision(blank, F.col("conf"), ink, F.col("text")).alias("code"))


D12 = f"""WITH {tables.PRINTED}, s AS (SELECT *, (doc_id + line_no) % 5 / 200.0::DOUBLE AS ink, line_no % 10 / 20.0::DOUBLE AS blank FROM lines),
u AS (SELECT *, blank >= 0.18 OR (conf < 0.58 AND ink < 0.012) AS odd FROM s)
SELECT doc_id, line_no, CASE WHEN odd AND (ink <= 0 OR (ink < 0.012 AND conf < 0.45 AND length(text) >= 6)) AND NOT regexp_matches(text, '\\p{{Nd}}') THEN 'tail_segment_suppressed' WHEN odd THEN 'tail_segment_uncertain' END AS code FROM u"""


def word_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of the words of every line."""
    n = F.greatest(F.length("text"), F.lit(1))
    p = F.transform(F.sequence(F.lit(1), n), lambda i: ((i * 37) % 100) / 100.0)
    c = F.transform(F.sequence(F.lit(1), n), lambda i: i / n)
    t = tables.printed(spark, sf).select(*KEY, "text", p.alias("p"), c.alias("c"))
    e = t.select(*KEY, F.posexplode(traces.word_evidence(F.col("text"), F.col("p"), F.col("c"))).alias("k", "w"))
    return e.select(*KEY, "k", "w.word", "w.start", F.round("w.p", 6).alias("p"))


A15 = f"""WITH {tables.PRINTED}, w AS (SELECT doc_id, line_no, text, regexp_extract_all(text, '{W}+') AS l, regexp_split_to_array(text, '{W}+') AS g FROM lines),
e AS (SELECT doc_id, line_no, unnest(range(len(l)))::INT AS k, l, g FROM w),
s AS (SELECT doc_id, line_no, k, l[k + 1] AS word, (list_sum(list_transform(g[1:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(l[1:k], lambda x: length(x))), 0))::INT AS start FROM e)
SELECT doc_id, line_no, k, word, start, round(list_sum(list_transform(range(start + 1, start + 1 + length(word)), lambda i: (i * 37) % 100 / 100.0::DOUBLE)) / length(word), 6) AS p FROM s"""


def log_text(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "conversations").select("conv_id", "turn", T.shortened(F.col("text"), 40).alias("short"), T.resized_width(F.length("text"), F.lit(3)).alias("width"))


F24 = """WITH t AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN length(x) <= 40 THEN x ELSE left(x, 39) || '…' END AS short, greatest(10, ceil(32 * length(text) / 3 / 10) * 10)::BIGINT AS width FROM t"""

QUERIES = {
    "n1_sequence_ratio": (sequence_ratio, None),
    "j4_token_alignment": (token_alignment, None),
    "f19_three_engine_separators": (three_engine_separators, None),
    "f20_legal_phrases": (legal_phrases, None),
    "d1_verifier_decision": (verifier_decision, None),
    "d4_semantic_decision": (semantic_decision, None),
    "d5_verifier_consensus": (verifier_consensus, None),
    "d6_consensus_retry": (consensus_retry, None),
    "d7_semantic_flow": (semantic_flow, None),
    "d8_remediation_flow": (remediation_flow, None),
    "d13_delete_only": (delete_only, None),
    "w7_near_repeats": (near_repeats, None),
    "t4_retry_priority": (retry_topn, T4),
    "p14_selective_verification": (selective, P14),
    "d12_tail_decision": (tails, D12),
    "a15_word_evidence": (word_evidence, A15),
    "f24_log_text": (log_text, F24),
}
