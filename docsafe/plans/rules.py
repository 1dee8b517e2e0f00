"""Queries over rules of text, payloads and rows that a sequence decides; their SQL follows rows by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsafe.functions import geometry as G
from docsafe.functions import text as T
from docsafe.functions import traces
from docsafe.operators import layout, order
from docsafe.plans import layout as layouts
from docsafe.plans import lines as L
from docsafe.sources import files, tables

KEY = ("doc_id", "line_no")
W = T.WORD


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with decomposed letters and blanks of other kinds."""
    raw = F.replace(F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü")), F.lit(", "), F.lit(",  "))
    raw = F.concat(raw, F.lit(" ấ ậ x́ "))
    return tables.lines(spark, sf).select(*KEY, T.normalized(raw).alias("text"), T.accentless(raw).alias("key"))


F1 = f"""WITH {tables.LINES}, r AS (SELECT doc_id, line_no, nfc_normalize(replace(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)), ', ', ',' || chr(160) || chr(8195)) || ' a' || chr(770) || chr(769) || ' a' || chr(803) || chr(770) || ' x' || chr(769) || ' ') AS text FROM lines)
SELECT doc_id, line_no, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) AS text, replace(replace(replace(strip_accents(lower(text)), 'đ', 'd'), 'ß', 'ss'), chr(769), '') AS key FROM r"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the four kinds, and the material text of one."""
    t = F.concat(F.lit("1.Điều 2.3a "), "text")
    joined = lambda a: F.array_join(a, "|")
    return tables.lines(spark, sf).select(
        *KEY, joined(T.retry_tokens(t)).alias("retry"), joined(T.simple_tokens(t)).alias("simple"), joined(T.marked_tokens(t)).alias("marked"), joined(T.strict_tokens(t)).alias("strict"), T.material(t).alias("material")
    )


F3 = f"""WITH {tables.LINES}, t AS (SELECT doc_id, line_no, '1.Điều 2.3a ' || text AS t FROM lines)
SELECT doc_id, line_no, array_to_string(regexp_extract_all(regexp_replace(t, '(\\p{{Nd}})\\.([\\p{{L}}\\p{{Nl}}\\p{{No}}])', '\\1 \\2', 'g'), '{W}+(?:[/.-]{W}+)*'), '|') AS retry, array_to_string(regexp_extract_all(t, '{W}+'), '|') AS simple,
array_to_string(regexp_extract_all(t, '{W}+|[^\\p{{L}}\\p{{N}}_\\s]'), '|') AS marked, array_to_string(list_transform(regexp_extract_all(t, '{W}+(?:[/.-]{W}+)*'), lambda x: replace(lower(x), 'ß', 'ss')), '|') AS strict,
array_to_string(list_transform(regexp_extract_all(t, '{W}+(?:[/.-]{W}+)*'), lambda x: replace(replace(strip_accents(lower(x)), 'đ', 'd'), 'ß', 'ss')), ' ') AS material FROM t"""


def trimmed_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without the loop that ends them; every third line has one."""
    more = F.when(F.col("line_no") % 3 == 0, F.lit(" thus a b a b a b")).when(F.col("line_no") % 3 == 1, F.lit(" 12 12 12")).otherwise(F.lit(""))
    looped = tables.lines(spark, sf).withColumn("text", F.concat("text", more))
    toks = looped.select(*KEY, F.posexplode(T.simple_tokens(F.lower("text"))).alias("pos", "tok"))
    found = order.ngram_loops(toks, list(KEY)).select(*KEY, F.col("start").alias("at"))
    place = F.get(traces.words(F.col("text")), F.col("at").cast("int"))["start"]
    return looped.join(found, list(KEY)).select(*KEY, T.trim_ngram_loop(F.col("text"), place).alias("text"))


LOOPED = "lines AS (SELECT doc_id, line_no, conf, text || CASE line_no % 3 WHEN 0 THEN ' thus a b a b a b' WHEN 1 THEN ' 12 12 12' ELSE '' END AS text FROM lined)"
F10 = f"""WITH {tables.LINES.replace('lines AS', 'lined AS', 1)}, {LOOPED}, found AS ({L.W5_PARTIAL.replace(f'WITH {tables.LINES},', 'WITH', 1).replace(f'WITH {tables.LINES},', 'WITH', 1)}),
w AS (SELECT l.doc_id, l.line_no, l.text, f.start, regexp_extract_all(l.text, '{W}+') AS l, regexp_split_to_array(l.text, '{W}+') AS g FROM lines l JOIN found f USING (doc_id, line_no)),
c AS (SELECT *, (list_sum(list_transform(g[1:start + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(l[1:start], lambda x: length(x))), 0))::INT AS place FROM w),
h AS (SELECT *, rtrim(left(text, place), ' ,;:-') AS head FROM c)
SELECT doc_id, line_no, CASE WHEN regexp_matches(substr(text, place + 1), '\\p{{Nd}}') THEN text WHEN len(regexp_extract_all(head, '{W}+')) < 2 OR length(head) < 4 THEN '' ELSE head END AS text FROM h"""


def trimmed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without the run of one character that ends them."""
    more = F.when(F.col("line_no") % 3 == 0, F.lit(" cong: aaaAaaa")).when(F.col("line_no") % 3 == 1, F.lit(" 0000000")).otherwise(F.lit("  "))
    return tables.lines(spark, sf).select(*KEY, T.trim_char_loop(F.concat("text", more)).alias("text"))


F11 = f"""WITH {tables.LINES}, t AS (SELECT doc_id, line_no, text || CASE line_no % 3 WHEN 0 THEN ' cong: aaaAaaa' WHEN 1 THEN ' 0000000' ELSE '  ' END AS text FROM lines),
chars AS (SELECT doc_id, line_no, i, c, i - row_number() OVER (PARTITION BY doc_id, line_no, c ORDER BY i) AS g FROM (SELECT doc_id, line_no, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(lower(text), '')) AS c FROM t) WHERE regexp_full_match(c, '{W}')),
runs AS (SELECT doc_id, line_no, min(start)::INT AS start FROM (SELECT doc_id, line_no, min(i) AS start FROM chars GROUP BY doc_id, line_no, c, g HAVING count(*) >= 6) GROUP BY ALL),
h AS (SELECT doc_id, line_no, text, start, rtrim(left(text, start - 1), ' ,.;:_-') AS head FROM t LEFT JOIN runs USING (doc_id, line_no))
SELECT doc_id, line_no, CASE WHEN start IS NULL OR regexp_matches(substr(text, start), '\\p{{Nd}}') THEN text WHEN len(regexp_extract_all(head, '{W}+')) < 2 THEN '' ELSE head END AS text FROM h"""


def without_span(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return tables.lines(spark, sf).select(*KEY, T.without_span(F.col("text"), F.floor(n / 3), F.floor(n / 2)).alias("text"))


F12 = f"""WITH {tables.LINES}, s AS (SELECT doc_id, line_no, rtrim(left(text, length(text) // 3)) AS a, ltrim(substr(text, length(text) // 2 + 1)) AS b FROM lines)
SELECT doc_id, line_no, CASE WHEN a = '' OR b = '' OR regexp_matches(b, '^[,.;:!?)\\]}}]') THEN a || b ELSE a || ' ' || b END AS text FROM s"""


def crop_pages(spark: SparkSession, sf: str) -> DataFrame:
    crop = F.when(F.col("doc_id") % 3 == 0, F.format_string("p%d-l%d", F.col("doc_id") % 40, F.col("line_no"))).otherwise(F.format_string("x%d", F.col("line_no")))
    return tables.lines(spark, sf).select(*KEY, T.page_of_crop(crop).alias("page"), T.crop_place(crop).alias("place"))


F25 = f"WITH {tables.LINES} SELECT doc_id, line_no, CASE WHEN doc_id % 3 = 0 THEN doc_id % 40 ELSE -1 END::INT AS page, CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id % 40 + 1 || ':l' || line_no + 1 ELSE 'x' || line_no END AS place FROM lines"


def compact_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of a log."""
    e = tables.table(spark, sf, "events")
    n, ms = F.col("event_id") % 50, (F.col("event_id") % 900) * 100
    kind = F.when(F.col("event_type") == "signup", "document_started").when(F.col("event_type") == "view", "native_routing_complete").when(F.col("event_type") == "purchase", "document_complete").otherwise(F.col("event_type"))
    name = F.concat(F.lit("a"), n.cast("string"), F.lit(".pdf"))
    line = T.compact_event(kind, {"filename": name, "page_count": n, "native_page_count": n % 7, "ocr_page_count": n % 5, "elapsed_ms": ms, "status": F.lit("partial"), "risk_count": n % 3, "ready": n % 2 == 0, "message": F.when(n % 2 == 0, F.col("event_type"))})
    return e.select("event_id", line.alias("line"))


SECONDS = "CASE WHEN (event_id % 900) * 100 >= 60000 THEN (event_id % 900) // 600 || 'm' || format('{:.0f}', (event_id % 900) / 10.0 - (event_id % 900) // 600 * 60) || 's' ELSE format('{:.1f}', (event_id % 900) / 10.0) || 's' END"
F26 = f"""SELECT event_id, CASE event_type WHEN 'signup' THEN '[OCR] Bắt đầu | a' || event_id % 50 || '.pdf | ' || event_id % 50 || ' trang'
WHEN 'view' THEN '[OCR] Phân tuyến | native=' || event_id % 50 % 7 || ' | ocr=' || event_id % 50 % 5 || ' | ' || {SECONDS}
WHEN 'purchase' THEN '[OCR] Hoàn tất | a' || event_id % 50 || '.pdf | trạng thái=PARTIAL | ' || {SECONDS} || ' | rủi ro=' || event_id % 50 % 3 || ' | AI-ready: ' || CASE WHEN event_id % 2 = 0 THEN 'CÓ' ELSE 'KHÔNG' END
ELSE '[OCR] ' || event_type END AS line FROM events"""


def unsupported_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of a turn that neither of the two turns before has."""
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id").orderBy("turn")
    t = tables.table(spark, sf, "conversations").select("conv_id", "turn", T.simple_tokens(F.lower("text")).alias("own"))
    nothing = F.array().cast("array<string>")
    t = t.withColumns({"a": F.coalesce(F.lag("own").over(by), nothing), "b": F.coalesce(F.lag("own", 2).over(by), nothing)})
    rest = F.filter("own", lambda x: ~F.array_contains(F.concat("a", "b"), x))
    return t.select("conv_id", "turn", F.array_join(rest, " ").alias("unsupported"))


U5 = f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{W}+') AS own FROM conversations),
p AS (SELECT *, list_concat(coalesce(lag(own) OVER w, []), coalesce(lag(own, 2) OVER w, [])) AS seen FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, array_to_string(list_filter(own, lambda x: NOT list_contains(seen, x)), ' ') AS unsupported FROM p"""


def tail_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    """How often the commonest pair of the last 28 tokens occurs there, and the share of distinct tokens."""
    tail = T.last_tokens(T.simple_tokens(F.lower("text")))
    t = tables.table(spark, sf, "documents").select("doc_id", tail.alias("tail"))
    return t.select("doc_id", T.tail_bigrams(F.col("tail")).alias("t")).select("doc_id", "t.*")


A16 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}+') AS a FROM documents),
t AS (SELECT doc_id, a[greatest(3, len(a) - 27):len(a)] AS a FROM w), p AS (SELECT doc_id, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) AS p FROM t),
c AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(p) AS x FROM p) GROUP BY ALL), m AS (SELECT doc_id, max(n) AS n FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(m.n, 0)::BIGINT AS most, CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_distinct(a))::DOUBLE / len(a)::DOUBLE END AS distinct_ratio FROM t LEFT JOIN m USING (doc_id)"""


def box_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Width, height and area of every box, and what it shares with the next of its page."""
    from pyspark.sql import Window

    by = Window.partitionBy("page").orderBy("line", "x0", "y0", "x1")
    b = tables.boxes(spark, sf).withColumns({f"n_{c}": F.lead(c).over(by) for c in layout.SIDES})
    own, other = tuple(F.col(c) for c in layout.SIDES), tuple(F.col(f"n_{c}") for c in layout.SIDES)
    return b.where("n_x0 is not null").select("page", "line", G.span(own[0], own[2]).alias("w"), G.span(own[1], own[3]).alias("h"), G.area(*own).alias("area"), F.round(G.iou(own, other), 9).alias("iou"))


P19 = f"""WITH {tables.BOXES}, n AS (SELECT *, lead(x0) OVER w AS a0, lead(y0) OVER w AS b0, lead(x1) OVER w AS a1, lead(y1) OVER w AS b1 FROM boxes WINDOW w AS (PARTITION BY page ORDER BY line, x0, y0, x1)),
s AS (SELECT *, greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) AS shared FROM n WHERE a0 IS NOT NULL)
SELECT page, line, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) AS area, round(shared / ((x1 - x0) * (y1 - y0) + (a1 - a0) * (b1 - b0) - shared), 9) AS iou FROM s"""


def _tsv(spark: SparkSession, sf: str) -> DataFrame:
    b, n = tables.boxes(spark, sf), F.col("line")
    conf = F.when(n % 7 == 0, F.lit("-1")).when(n % 11 == 0, F.lit("abc")).when(n % 17 == 0, F.lit("")).otherwise((F.round(F.col("conf") * 100).cast("int")).cast("string"))
    text = F.when(n % 13 == 0, F.lit("  ")).otherwise(F.concat(F.lit('"w'), n.cast("string")))
    whole = lambda c: c.cast("long").cast("string")
    cells = [F.lit("5"), whole(F.col("page")), whole(n % 3), whole(n % 2), whole(F.col("y0") / 40), whole(n), whole(F.col("x0")), F.when(n % 19 == 0, F.lit("?")).otherwise(whole(F.col("y0"))), whole(F.col("x1") - F.col("x0")), whole(F.col("y1") - F.col("y0")), conf, text]
    return b.select(F.concat_ws("\t", *cells).alias("value"), n.alias("position"))


def verifier_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a verifier's tables as lines."""
    return files.verifier_lines(files.parsed_words(_tsv(spark, sf)))


A1 = f"""WITH {tables.BOXES}, w AS (SELECT page, line % 3 AS block, line % 2 AS par, floor(y0 / 40)::BIGINT AS row, line, '"w' || line AS word, round(conf * 100) / 100 AS conf, x0, y0, x0 + floor(x1 - x0) AS x1, y0 + floor(y1 - y0) AS y1 FROM boxes WHERE line % 7 > 0 AND line % 11 > 0 AND line % 17 > 0 AND line % 13 > 0 AND line % 19 > 0)
SELECT page AS page_num, block AS block_num, par AS par_num, row AS line_num, string_agg(word, ' ' ORDER BY line) AS text, round(least(1.0, greatest(0.0, sum(conf * length(word)) / sum(length(word)))), 9) AS confidence, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM w GROUP BY ALL"""


def detector_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of both namings, with polygons of three points, and fewer scores than polygons."""
    i = F.col("vec_id")
    polys = F.format_string("[[[0,0],[%d,0],[%d,5],[0,5]],[[1,1],[2,2],[3,3]],[[1,1],[2,1],[2,2],[1,%d]]]", i, i, i)
    payload = F.when(i % 3 == 0, F.format_string('{"dt_polys": %s, "dt_scores": [0.5, 0.25]}', polys)).when(i % 3 == 1, F.format_string('{"polys": %s, "scores": [0.75]}', polys)).otherwise(F.lit('{"other": 1}'))
    p = files.detector_polygons(tables.table(spark, sf, "embeddings").select(i.alias("page_index"), payload.alias("payload")))
    return p.select("page_index", "polygon", F.size("points").cast("long").alias("n"), F.get(F.get("points", F.lit(3)), F.lit(1)).alias("y"), "score")


S8 = """SELECT vec_id AS page_index, p::INT AS polygon, 4::BIGINT AS n, CASE p WHEN 0 THEN 5.0 ELSE vec_id END::DOUBLE AS y, CASE WHEN p = 2 THEN 1.0 WHEN vec_id % 3 = 0 THEN 0.5 ELSE 0.75 END::DOUBLE AS score
FROM embeddings, (VALUES (0), (2)) t(p) WHERE vec_id % 3 < 2"""


def secondary_payloads(spark: SparkSession, sf: str) -> DataFrame:
    t = tables.table(spark, sf, "conversations")
    one = F.struct(F.col("text").alias("rec_text"), F.when(F.col("turn") % 2 == 0, F.lit(0.25)).alias("rec_score"))
    payload = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(one.alias("res")))).otherwise(F.to_json(one))
    return files.secondary_readings(t.select(F.concat_ws("-", "conv_id", "turn").alias("crop_id"), payload.alias("payload")))


S9 = "SELECT conv_id || '-' || turn AS crop_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g')) AS text, CASE WHEN turn % 2 = 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS confidence FROM conversations"


def terms(spark: SparkSession, sf: str) -> DataFrame:
    given = tables.table(spark, sf, "benchmark").select(F.explode(F.split("text", r"\.")).alias("value"))
    comments = given.select(F.concat(F.lit(" # "), "value").alias("value"))
    return files.parsed_terms(given.unionByName(comments).unionByName(given), ["given", " given "]).select("term", "rank")


S10 = """WITH t AS (SELECT DISTINCT trim(v, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS term FROM (SELECT unnest(string_split(text, '.')) AS v FROM benchmark UNION ALL SELECT 'given'))
SELECT term, row_number() OVER (ORDER BY -length(term), lower(term), term)::INT AS rank FROM t WHERE term <> '' AND NOT starts_with(term, '#')"""


def upload_names(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("page_id") % 4 == 0, F.lit("")).when(F.col("page_id") % 4 == 1, F.concat("url", F.lit(".PDF"))).when(F.col("page_id") % 4 == 2, F.concat("url", F.lit(".pdf/"))).otherwise(F.col("url"))
    name = files.document_name(path)
    return tables.table(spark, sf, "pages").select("page_id", name.alias("name"), files.is_pdf_name(name).alias("pdf"))


P1 = """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN url || '.PDF' WHEN 2 THEN url || '.pdf/' ELSE url END AS path FROM pages),
n AS (SELECT page_id, coalesce(nullif(regexp_extract(rtrim(path, '/'), '[^/]+$'), ''), 'document.pdf') AS name FROM p) SELECT page_id, name, ends_with(lower(name), '.pdf') AS pdf FROM n"""


def results_json(spark: SparkSession, sf: str) -> DataFrame:
    """Results as JSON objects, with pages in every second document."""
    d = tables.table(spark, sf, "documents")
    pages = d.groupBy(F.floor(F.col("doc_id") / 8).alias("document")).agg(F.array_sort(F.collect_list(F.struct((F.col("doc_id") % 8).alias("page_index"), F.col("lang").alias("source")))).alias("pages"), F.count("*").alias("page_count"))
    whole = files.result_json(pages, ["document", "page_count", "pages"]).where("document % 2 = 0")
    return whole.unionByName(files.result_json(pages, ["document", "page_count", "pages"], without=["pages"]).where("document % 2 = 1"))


K1 = """WITH p AS (SELECT doc_id // 8 AS document, count(*) AS page_count, string_agg('{"page_index":' || doc_id % 8 || ',"source":"' || lang || '"}', ',' ORDER BY doc_id % 8) AS pages FROM documents GROUP BY 1)
SELECT document, '{"document":' || document || ',"page_count":' || page_count || CASE WHEN document % 2 = 0 THEN ',"pages":[' || pages || ']' ELSE '' END || '}' AS value FROM p"""

# Rows by recursion: the box after the last one of a page joins its row or begins the next.
ROWS = f"""{tables.BOXES}, o AS (SELECT *, (y0 + y1) / 2 AS c, row_number() OVER (PARTITION BY page ORDER BY y0, x0, line, y1) AS k, median(y1 - y0) OVER (PARTITION BY page) AS med FROM boxes),
rowed AS (SELECT page, line, x0, y0, x1, y1, conf, k, 0 AS row, c AS s, 1 AS n, med FROM o WHERE k = 1
 UNION ALL SELECT o.page, o.line, o.x0, o.y0, o.x1, o.y1, o.conf, o.k, CASE WHEN abs(o.c - r.s / r.n) <= %s THEN r.row ELSE r.row + 1 END, CASE WHEN abs(o.c - r.s / r.n) <= %s THEN r.s + o.c ELSE o.c END, CASE WHEN abs(o.c - r.s / r.n) <= %s THEN r.n + 1 ELSE 1 END, o.med
 FROM rowed r JOIN o ON o.page = r.page AND o.k = r.k + 1)"""
HALF = ROWS.replace("%s", "greatest(o.med / 2, 1)")
W3 = f"WITH RECURSIVE {HALF} SELECT page, line, row, row_number() OVER (PARTITION BY page ORDER BY row, x0, line)::INT AS reading_rank FROM rowed"
A18 = f"WITH RECURSIVE {HALF}, r AS (SELECT page, row, count(*) AS n FROM rowed GROUP BY ALL) SELECT page, count(*) AS n_rows, count(*) FILTER (n >= 2) AS wide_rows FROM r GROUP BY page"
JOINS = """x0 - f.x1 BETWEEN -0.15 * greatest(f.y1 - f.y0, h) AND greatest(4.0, greatest(f.y1 - f.y0, h)) AND least(f.x1 - f.x0, w) <= greatest(8.0, 1.8 * greatest(f.y1 - f.y0, h))
 AND greatest(0, least(f.y1, y1) - greatest(f.y0, y0)) / greatest(1, least(f.y1 - f.y0, h)) >= 0.62 AND greatest(f.y1 - f.y0, h) / greatest(1, least(f.y1 - f.y0, h)) <= 1.8"""
W4 = f"""WITH RECURSIVE {ROWS.replace('%s', 'greatest(0.22 * o.med, 1)')}, q AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, row_number() OVER (PARTITION BY page, row ORDER BY x0, k) AS j FROM rowed),
f AS (SELECT page, row, j, line, x0, y0, x1, y1, conf, 1 AS pieces, j AS head FROM q WHERE j = 1
 UNION ALL SELECT page, row, j, CASE WHEN near THEN f_line ELSE line END, CASE WHEN near THEN least(fx0, x0) ELSE x0 END, CASE WHEN near THEN least(fy0, y0) ELSE y0 END, CASE WHEN near THEN greatest(fx1, x1) ELSE x1 END, CASE WHEN near THEN greatest(fy1, y1) ELSE y1 END, CASE WHEN near THEN least(fconf, conf) ELSE conf END, CASE WHEN near THEN pieces + 1 ELSE 1 END, CASE WHEN near THEN head ELSE j END
 FROM (SELECT q.page, q.row, q.j, q.line, q.x0, q.y0, q.x1, q.y1, q.conf, f.line AS f_line, f.x0 AS fx0, f.y0 AS fy0, f.x1 AS fx1, f.y1 AS fy1, f.conf AS fconf, f.pieces, f.head, {JOINS.replace('least(f.y1, y1)', 'least(f.y1, q.y1)').replace('greatest(f.y0, y0)', 'greatest(f.y0, q.y0)').replace('x0 - f.x1 BETWEEN', 'q.x0 - f.x1 BETWEEN', 1)} AS near FROM f JOIN q ON q.page = f.page AND q.row = f.row AND q.j = f.j + 1))
SELECT page, line, pieces::BIGINT AS pieces, x0, y0, x1, y1, conf FROM f QUALIFY row_number() OVER (PARTITION BY page, row, head ORDER BY j DESC) = 1"""
J5 = f"""WITH RECURSIVE {tables.BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY conf DESC, line, x0, y0, x1, y1) AS k FROM boxes),
f AS (SELECT page, k, line, true AS kept, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS held FROM o WHERE k = 1
 UNION ALL SELECT page, k, line, free, CASE WHEN free THEN list_append(held, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) ELSE held END FROM (
  SELECT o.*, f.held, len(list_filter(list_transform(f.held, lambda b: {{'s': greatest(0, least(o.x1, b.x1) - greatest(o.x0, b.x0)) * greatest(0, least(o.y1, b.y1) - greatest(o.y0, b.y0)), 'a': (o.x1 - o.x0) * (o.y1 - o.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)}}), lambda u: u.a - u.s > 0 AND u.s > 0.85 * (u.a - u.s))) = 0 AS free
  FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1))
SELECT page, line FROM f WHERE kept"""
W14 = f"""WITH RECURSIVE {tables.LINES}, i AS (SELECT doc_id // 32 AS grp, doc_id * 10000 + line_no AS item, greatest(10, ceil(length(text) * 0.8::DOUBLE) * 10)::BIGINT AS width FROM lines),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY width, item) AS k FROM i),
f AS (SELECT grp, item, k, 0::BIGINT AS batch, 1::BIGINT AS n, width AS low FROM o WHERE k = 1
 UNION ALL SELECT grp, item, k, batch + shut::INT, CASE WHEN shut THEN 1 ELSE n + 1 END, CASE WHEN shut THEN width ELSE low END FROM (SELECT o.*, f.batch, f.n, f.low, f.n + 1 > 32 OR o.width * (f.n + 1) > 12288 OR o.width / greatest(f.low, 1) > 2.0 AS shut FROM f JOIN o ON o.grp = f.grp AND o.k = f.k + 1))
SELECT grp AS "group", item, batch FROM f"""
J6 = f"""WITH RECURSIVE {tables.LINES}, l AS (SELECT doc_id AS page, line_no, text, conf, CASE WHEN conf < 0.2 THEN 2 WHEN conf < 0.5 THEN 1 ELSE 0 END AS r, (line_no // 2 * 40 + line_no % 2)::DOUBLE AS y FROM lines),
f AS (SELECT page, line_no, text, conf, r, line_no AS head, text AS last, y AS top FROM l WHERE line_no = 0
 UNION ALL SELECT page, line_no, text, conf, r, CASE WHEN same THEN head ELSE line_no END, CASE WHEN same THEN last ELSE text END, CASE WHEN same THEN top ELSE y END FROM (
  SELECT l.*, f.head, f.last, f.top, l.text <> '' AND l.text = f.last AND greatest(0, least(l.y, f.top) + 30 - greatest(l.y, f.top)) / (60 - greatest(0, least(l.y, f.top) + 30 - greatest(l.y, f.top))) >= 0.8 AS same FROM f JOIN l ON l.page = f.page AND l.line_no = f.line_no + 1))
SELECT page, head AS line_no, arg_min(text, line_no) AS text, min(conf) AS conf, ['none', 'medium', 'high'][max(r) + 1] AS risk,
coalesce(array_to_string(list_distinct(list(CASE r WHEN 2 THEN 'high_confidence' WHEN 1 THEN 'medium_confidence' END ORDER BY line_no) FILTER (r > 0)), ','), '') AS reasons, count(*) AS merged FROM f GROUP BY page, head"""


def geometric_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    g = L.geometric_duplicates(spark, sf)
    return g.withColumns({"line_no": F.col("line_no").cast("int"), "reasons": F.array_join(F.array_sort("reasons"), ",")})


QUERIES = {
    "t1_reading_order": (L.reading_order, W3),
    "a18_table_rows": (L.table_rows, A18),
    "j5_overlap_suppression": (L.suppress_overlaps, J5),
    "w14_adaptive_batches": (L.batches, W14),
    "w4_fragment_merge": (layouts.fragments, W4),
    "f1_normalized": (normalized, F1),
    "f3_f4_f6_f7_tokens": (tokens, F3),
    "f10_trimmed_loops": (trimmed_loops, F10),
    "f11_trimmed_runs": (trimmed_runs, F11),
    "f12_without_span": (without_span, F12),
    "f25_crop_pages": (crop_pages, F25),
    "f26_compact_log": (compact_log, F26),
    "u5_unsupported_tokens": (unsupported_tokens, U5),
    "a16_tail_bigrams": (tail_bigrams, A16),
    "p19_box_overlaps": (box_overlaps, P19),
    "s6_a1_verifier_lines": (verifier_lines, A1),
    "s8_detector_payloads": (detector_payloads, S8),
    "s9_secondary_payloads": (secondary_payloads, S9),
    "s10_u3_terms": (terms, S10),
    "p1_upload_names": (upload_names, P1),
    "k1_results_json": (results_json, K1),
    "j6_d17_duplicate_merge": (geometric_duplicates, J6.replace("array_to_string(list_distinct(", "array_to_string(list_sort(list_distinct(").replace("FILTER (r > 0)), ','", "FILTER (r > 0))), ','")),
}
