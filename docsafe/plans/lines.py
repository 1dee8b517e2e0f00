"""Queries over lines and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsafe.functions import geometry as G
from docsafe.functions import readings as R
from docsafe.functions import text as T
from docsafe.operators import layout, order
from docsafe.sources import tables

KEY = ("doc_id", "line_no")
W = r"[\p{L}\p{N}_]"


def _over(name: str, column):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return tables.lines(spark, sf).select(*KEY, *column(F.col("text")))

    query.__name__ = name
    return query


tokens = _over("tokens", lambda t: (F.size(T.lexical_tokens(t)).cast("long").alias("n"), F.array_join(T.lexical_tokens(t), "|").alias("tokens")))
keys = _over("keys", lambda t: (T.accentless(t).alias("key"),))
numbers = _over("numbers", lambda t: (F.array_join(T.numeric_tokens(T.lexical_tokens(t)), "|").alias("numbers"), F.array_join(F.transform(T.lexical_tokens(t), F.lower), " ").alias("strict")))
marks = _over("marks", lambda t: (T.punctuation_signature(t).alias("signature"), T.diacritics(F.concat(t, F.lit(" Tiếng Việt ệ"))).alias("diacritics")))

TOK = f"regexp_extract_all(text, '{W}+(?:[/.-]{W}+)*')"
ACC = "replace(replace(strip_accents(lower(text)), 'đ', 'd'), 'ß', 'ss')"


def decoder_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Whole and partial loops."""
    t = tables.lines(spark, sf).select(*KEY, F.posexplode(T.simple_tokens(F.lower("text"))).alias("pos", "tok"))
    return order.ngram_loops(t, list(KEY))


LAGS = " UNION ALL ".join(f"SELECT doc_id, line_no, pos, {k}::BIGINT AS k, tok = lag(tok, {k}) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS eq FROM toks" for k in (1, 2, 3, 4))
W5 = f"""WITH {tables.LINES},
toks AS (SELECT doc_id, line_no, unnest(range(len(l))) AS pos, unnest(l) AS tok FROM (SELECT doc_id, line_no, regexp_extract_all(lower(text), '{W}+') AS l FROM lines)),
eqs AS (SELECT * FROM ({LAGS}) WHERE eq),
runs AS (SELECT doc_id, line_no, k, count(*) AS n, min(pos) AS first FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, line_no, k ORDER BY pos) AS g FROM eqs) GROUP BY doc_id, line_no, k, g),
ranked AS (SELECT *, n // k + 1 AS repeats, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY n // k DESC, k DESC, first - k) AS r FROM runs WHERE n // k + 1 >= 3)
SELECT doc_id, line_no, repeats::BIGINT AS repeats, k AS ngram, (first - k)::BIGINT AS start FROM ranked WHERE r = 1"""
W5_PARTIAL = f"""WITH {tables.LINES},
toks AS (SELECT doc_id, line_no, regexp_extract_all(lower(text), '{W}+') AS l FROM lines),
tails AS (SELECT doc_id, line_no, k::BIGINT AS k, q::BIGINT AS q, (len(l) - 2 * k - q)::BIGINT AS start FROM toks, range(2, 5) a(k), range(1, 4) b(q)
  WHERE q < k AND 2 * q >= k AND len(l) >= 2 * k + q AND l[len(l) - k - q + 1:len(l)] = l[len(l) - 2 * k - q + 1:len(l) - k]),
whole AS ({W5}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY q DESC, k DESC, start) AS r FROM tails)
SELECT doc_id, line_no, repeats, ngram, start, 0::BIGINT AS partial FROM whole
UNION ALL SELECT doc_id, line_no, 2::BIGINT, k, start, q FROM ranked ANTI JOIN whole USING (doc_id, line_no) WHERE r = 1"""


def seam_overlap(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("conv_id").orderBy("turn")
    t = tables.table(spark, sf, "conversations").select("conv_id", "turn", T.simple_tokens(F.col("text")).alias("a"))
    return t.withColumn("b", F.lead("a").over(by)).where("b is not null").select("conv_id", "turn", T.seam_overlap(F.col("a"), F.col("b")).alias("overlap"))


F9 = f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{W}+') AS a FROM conversations),
p AS (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, coalesce(list_max(list_filter([1, 2, 3, 4], lambda n: len(a) >= n AND len(b) >= n AND a[len(a) - n + 1:len(a)] = b[1:n])), 0)::BIGINT AS overlap FROM p WHERE b IS NOT NULL"""


def seam_merge(spark: SparkSession, sf: str) -> DataFrame:
    t = tables.table(spark, sf, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.where("next is not null").select("conv_id", "turn", R.seam_merge("text", "next").alias("m")).select("conv_id", "turn", "m.*")


def joined_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Printed lines from three segments of some six words each, of which every one begins with the last word before it."""
    t = tables.printed(spark, sf).withColumn("w", F.split("text", " "))
    parts = F.array(*[F.array_join(F.slice("w", a, n), " ") for a, n in ((1, 6), (6, 6), (11, 6))])
    return t.select(*KEY, R.segment_join(parts).alias("j")).select(*KEY, "j.*")


def geometric_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """A page is a document; every other line stands where the line before it does, but for a little."""
    n = F.col("line_no")
    y0 = (F.floor(n / 2) * 40 + n % 2).cast("double")
    risk = F.when(F.col("conf") < 0.2, F.lit("high")).when(F.col("conf") < 0.5, F.lit("medium")).otherwise(F.lit("none"))
    reasons = F.when(risk == "none", F.array().cast("array<string>")).otherwise(F.array(F.concat(risk, F.lit("_confidence"))))
    t = tables.lines(spark, sf).select(F.col("doc_id").alias("page"), "line_no", "text", "conf", risk.alias("risk"), reasons.alias("reasons"))
    return order.geometric_duplicates(t.withColumns({"x0": F.lit(100.0), "y0": y0, "x1": F.lit(900.0), "y1": y0 + 30}))


def seed_topk(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy(F.col("conf"), "line_no")
    return tables.lines(spark, sf).withColumn("rank", F.row_number().over(by)).where("rank <= 8").select(*KEY, "conf", "rank")


T3 = f"WITH {tables.LINES} SELECT doc_id, line_no, conf, row_number() OVER (PARTITION BY doc_id ORDER BY conf, line_no)::INT AS rank FROM lines QUALIFY rank <= 8"


def split_closure(spark: SparkSession, sf: str) -> DataFrame:
    seeds = F.max((F.col("conf") < 0.05).cast("int")).over(Window.partitionBy("doc_id")) == 1
    return tables.lines(spark, sf).withColumn("near", seeds).where("near and text <> ''").select(*KEY, (F.col("conf") >= 0.05).alias("context_only"))


J11 = f"WITH {tables.LINES} SELECT doc_id, line_no, conf >= 0.05 AS context_only FROM lines WHERE text <> '' AND doc_id IN (SELECT doc_id FROM lines WHERE conf < 0.05)"


def vertical_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return order.vertical_blocks(tables.boxes(spark, sf)).select("page", "line", "block")


W2 = f"""WITH {tables.BOXES}, g AS (SELECT *, greatest(1.25 * median(y1 - y0) OVER (PARTITION BY page), 22.0, 8.0) AS gap,
max(y1) OVER (PARTITION BY page ORDER BY y0, x0, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM boxes)
SELECT page, line, sum((low IS NOT NULL AND y0 - low > gap)::INT) OVER (PARTITION BY page ORDER BY y0, x0, line ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM g"""


def polygon_filter(spark: SparkSession, sf: str) -> DataFrame:
    b = tables.boxes(spark, sf).select("page", "line", ((F.col("x1") - F.col("x0")) / 20 - 2).alias("w"), ((F.col("y1") - F.col("y0")) / 2).alias("h"))
    return b.withColumn("kind", G.polygon_kind(F.col("w"), F.col("h"), F.col("w") * F.col("h"))).where("kind is not null")


P12 = f"""WITH {tables.BOXES}, s AS (SELECT page, line, (x1 - x0) / 20 - 2 AS w, (y1 - y0) / 2 AS h FROM boxes)
SELECT * FROM (SELECT *, CASE WHEN w >= 8 AND h >= 6 AND w * h >= 96 THEN 'normal' WHEN w >= 3 AND h >= 10 AND w * h >= 28 AND h / greatest(w, 1) >= 1.35 THEN 'narrow' END AS kind FROM s) WHERE kind IS NOT NULL"""


def page_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of every page, boxes of every second order against those of the others."""
    b = tables.boxes(spark, sf).withColumn("side", F.floor(F.col("line") / 8) % 2)
    return layout.match_candidates(b.where("side = 0"), b.where("side = 1"))


J2 = f"""WITH {tables.BOXES}, p AS (SELECT a.page, a.line AS crop, b.line AS other, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS down, least(a.y1 - a.y0, b.y1 - b.y0) AS h,
  least(a.x1, b.x1) - greatest(a.x0, b.x0) AS across, least(a.x1 - a.x0, b.x1 - b.x0) AS w
  FROM boxes a JOIN boxes b ON a.page = b.page AND a.line // 8 % 2 = 0 AND b.line // 8 % 2 = 1),
s AS (SELECT page, crop, other, 0.75::DOUBLE * least(greatest(down, 0) / greatest(h, 1), 1) + 0.25::DOUBLE * least(greatest(across, 0) / greatest(w, 1), 1) AS score FROM p)
SELECT * FROM s WHERE score >= 0.55"""


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return order.reading_order(tables.boxes(spark, sf)).select("page", "line", "row", "reading_rank")


def suppress_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return order.suppress_overlaps(tables.boxes(spark, sf))


def batches(spark: SparkSession, sf: str) -> DataFrame:
    t = tables.lines(spark, sf).select(F.floor(F.col("doc_id") / 32).alias("group"), (F.col("doc_id") * 10_000 + F.col("line_no")).alias("item"), F.greatest(F.lit(10), F.ceil(F.length("text") * 0.8) * 10).alias("width"))
    return order.batches(t)


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = order.row_groups(tables.boxes(spark, sf)).select("page", F.explode("rows").alias("r"))
    return rows.groupBy("page").agg(F.count("*").alias("n_rows"), F.count_if(F.size("r") >= 2).alias("wide_rows"))


def line_union(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a line in input order, confidence by length, the box around all."""
    b = tables.boxes(spark, sf).withColumn("word", F.concat(F.lit("w"), F.col("line").cast("string")))
    n = F.greatest(F.length("word"), F.lit(1))
    return b.groupBy("page", "y0").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "word"))), lambda x: x["word"]), " ").alias("text"), (F.sum(F.round(F.col("conf") * 100).cast("long") * n) / F.sum(n) / 100).alias("confidence"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


A1 = f"""WITH {tables.BOXES}, w AS (SELECT *, 'w' || line AS word FROM boxes)
SELECT page, y0, string_agg(word, ' ' ORDER BY line) AS text, sum(round(conf * 100)::BIGINT * length(word))::DOUBLE / sum(length(word))::DOUBLE / 100 AS confidence, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1 FROM w GROUP BY page, y0"""


def term_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that hold a term, case aside. The longest of a term's inner tokens stands whole in every such line and finds
    candidates by an equality join; terms of fewer than three tokens have none and are looked for in every line, in the
    broadcast list of them that Catalyst makes while it is small."""
    t = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("term_id"), F.lower(F.element_at(F.split("text", r"[.\n]"), 1)).alias("term")).where("length(term) > 3")
    inner = t.withColumn("tok", T.simple_tokens(F.col("term")))
    inner = inner.withColumn("probe", F.get(F.array_sort(F.slice("tok", 2, F.greatest(F.size("tok") - 2, F.lit(0))), lambda a, b: F.length(b) - F.length(a)), F.lit(0))).drop("tok")
    lines = tables.lines(spark, sf).select(*KEY, F.lower("text").alias("low"))
    probed = lines.select(*KEY, "low", F.explode(F.array_distinct(T.simple_tokens(F.col("low")))).alias("probe")).join(inner.where("probe is not null"), "probe").where(F.contains("low", "term"))
    short = lines.join(inner.where("probe is null").drop("probe"), F.contains("low", "term"))
    return probed.select(*KEY, "term_id").unionByName(short.select(*KEY, "term_id")).distinct()


J8 = f"""WITH {tables.LINES}, t AS (SELECT item_id AS term_id, lower(string_split_regex(text, '[.\\n]')[1]) AS term FROM benchmark WHERE length(string_split_regex(text, '[.\\n]')[1]) > 3)
SELECT DISTINCT l.doc_id, l.line_no, t.term_id FROM lines l JOIN t ON contains(lower(l.text), t.term)"""

QUERIES = {
    "f2_lexical_tokens": (tokens, f"WITH {tables.LINES} SELECT doc_id, line_no, len({TOK})::BIGINT AS n, array_to_string({TOK}, '|') AS tokens FROM lines"),
    "f5_accentless_key": (keys, f"WITH {tables.LINES} SELECT doc_id, line_no, {ACC} AS key FROM lines"),
    "f8_numeric_tokens": (numbers, f"WITH {tables.LINES} SELECT doc_id, line_no, array_to_string(list_filter({TOK}, lambda x: regexp_matches(x, '\\p{{Nd}}')), '|') AS numbers, lower(array_to_string({TOK}, ' ')) AS strict FROM lines"),
    "f13_punctuation_signature": (marks, f"WITH {tables.LINES} SELECT doc_id, line_no, array_to_string(regexp_extract_all(text, '\\p{{P}}'), '') AS signature, (len(list_filter(string_split(text, ''), lambda c: c <> strip_accents(c))) + len(list_filter(string_split(text, ''), lambda c: contains('{"".join(c for c, n in T.MARKS.items() if n == 2)}', c))))::BIGINT AS diacritics FROM (SELECT doc_id, line_no, text || ' Tiếng Việt ệ' AS text FROM lines)"),
    "w5_ngram_loops": (decoder_loops, W5_PARTIAL),
    "f9_seam_overlap": (seam_overlap, F9),
    "f9_seam_merge": (seam_merge, None),
    "w15_joined_segments": (joined_segments, None),
    "t3_seed_topk": (seed_topk, T3),
    "j11_split_closure": (split_closure, J11),
    "w2_vertical_blocks": (vertical_blocks, W2),
    "p12_polygon_filter": (polygon_filter, P12),
    "j2_spatial_candidates": (page_candidates, J2),
    "a1_line_union": (line_union, A1),
    "j8_term_audit": (term_audit, J8),
}
