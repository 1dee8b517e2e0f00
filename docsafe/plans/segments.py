"""Queries over attention and ink profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsafe.functions import decisions as D
from docsafe.functions import traces
from docsafe.operators import evidence as grounds
from docsafe.operators import spans
from docsafe.sources import tables


def attention(c):
    """Weights as doubles, none below 0, summing to 1; a row without mass is even."""
    up = F.transform(c, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    total = F.aggregate(up, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(up, lambda x: x / total)).otherwise(F.transform(c, lambda x: F.lit(1.0) / F.size(c)))


def centre(a):
    n = F.size(a) - 1
    return F.aggregate(F.transform(a, lambda x, i: x * i / n), F.lit(0.0), lambda s, x: s + x)


def centre_spread(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "embeddings").select("vec_id", attention(F.col("embedding")).alias("a")).withColumn("c", centre(F.col("a")))
    ink = F.aggregate(F.transform("a", lambda x, i: x * (i % 7) / 7.0), F.lit(0.0), lambda s, x: s + x)
    spread = F.sqrt(F.aggregate(F.transform("a", lambda x, i: x * F.pow(i / (F.size("a") - 1) - F.col("c"), 2)), F.lit(0.0), lambda s, x: s + x))
    return e.select("vec_id", F.round("c", 6).alias("centre"), F.round(spread, 6).alias("spread"), F.round(ink, 6).alias("ink"))


ATT = """att AS (SELECT vec_id, list_transform(u, lambda x: CASE WHEN list_sum(u) > 0 THEN x / list_sum(u) ELSE 1.0 / len(u) END) AS a FROM (
  SELECT vec_id, list_transform(embedding, lambda x: greatest(x::DOUBLE, 0.0)) AS u FROM embeddings))"""
N7 = f"""WITH {ATT}, c AS (SELECT vec_id, a, list_sum(list_transform(a, lambda x, i: x * (i - 1) / (len(a) - 1))) AS c FROM att)
SELECT vec_id, round(c, 6) AS centre, round(sqrt(list_sum(list_transform(a, lambda x, i: x * pow((i - 1) / (len(a) - 1) - c, 2)))), 6) AS spread, round(list_sum(list_transform(a, lambda x, i: x * ((i - 1) % 7) / 7.0::DOUBLE)), 6) AS ink FROM c"""


def ink_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen bins of mean ink against the largest, clipped, and the last bin with ink as a share of the width; every
    ninth has no ink at all."""
    e = tables.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(F.col("vec_id") % 9 == 0, F.lit(0.0)).otherwise(F.abs(x.cast("double")))).alias("v"))
    p = traces.ink_profile(F.col("v"), 16)
    return e.select("vec_id", p.alias("p")).select("vec_id", F.round(traces.total(F.col("p")), 6).alias("total"), F.round(traces.last_ink(F.col("p")), 9).alias("last_ink"))


A20 = """WITH b AS (SELECT vec_id, list_transform(range(16), lambda k: list_sum(list_transform(embedding[k * 4 + 1:k * 4 + 4], lambda x: CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE abs(x::DOUBLE) END)) / 4) AS b FROM embeddings),
p AS (SELECT vec_id, list_transform(b, lambda x: least(1.0, x / greatest(list_max(b), 1e-6))) AS p FROM b),
l AS (SELECT vec_id, p, list_max(list_transform(p, lambda x, i: CASE WHEN x >= 0.05 THEN i - 1 ELSE -1 END)) AS l FROM p)
SELECT vec_id, round(list_sum(p), 6) AS total, round(CASE WHEN l < 0 THEN 1.0 ELSE l / 15.0 END::DOUBLE, 9) AS last_ink FROM l"""


def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Probability and support floors from the medians of the stable prefix of a trace."""
    e = tables.table(spark, sf, "embeddings").select("vec_id", F.explode(F.slice("embedding", 1, 58)).alias("x"))
    m = e.groupBy("vec_id").agg(F.median(F.abs(F.col("x").cast("double"))).alias("m"))
    return m.select("vec_id", F.round(F.least(F.lit(0.72), F.greatest(F.lit(0.56), 0.68 * F.col("m") * 8)), 6).alias("p_floor"), F.round(F.least(F.lit(0.18), F.greatest(F.lit(0.10), 0.28 * F.col("m") * 4)), 6).alias("s_floor"))


A14 = """WITH m AS (SELECT vec_id, median(abs(x::DOUBLE)) AS m FROM (SELECT vec_id, unnest(embedding[1:58]) AS x FROM embeddings) GROUP BY vec_id)
SELECT vec_id, round(least(0.72, greatest(0.56, 0.68 * m * 8)), 6) AS p_floor, round(least(0.18, greatest(0.10, 0.28 * m * 4)), 6) AS s_floor FROM m"""


def hallucination(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    share = lambda k: ((i * k) % 100) / 100.0
    return tables.table(spark, sf, "embeddings").select("vec_id", F.round(D.hallucination_risk(i % 2 == 0, i % 3 == 0, share(7), i % 5 == 0, share(13), share(3) / 10, share(11) / 4, share(17) / 2), 6).alias("risk"))


N12 = """SELECT vec_id, round(least(1.0, CASE WHEN vec_id % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN vec_id % 3 = 0 THEN 0.08 ELSE 0 END + least(0.25, 0.8 * a) + CASE WHEN vec_id % 5 = 0 THEN 0.20 ELSE 0 END
 + CASE WHEN p < 0.78 THEN least(0.25, 0.78 - p) ELSE 0 END + CASE WHEN k < 0.018 THEN 0.12 ELSE 0 END + CASE WHEN b >= 0.10 THEN least(0.22, 0.5 * b) ELSE 0 END + CASE WHEN d > 0.20 THEN 0.18 ELSE 0 END), 6) AS risk
FROM (SELECT vec_id, ((vec_id * 7) % 100) / 100.0::DOUBLE AS a, ((vec_id * 13) % 100) / 100.0::DOUBLE AS p, ((vec_id * 3) % 100) / 100.0::DOUBLE / 10 AS k, ((vec_id * 11) % 100) / 100.0::DOUBLE / 4 AS b, ((vec_id * 17) % 100) / 100.0::DOUBLE / 2 AS d FROM embeddings)"""

def grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Attention of eight steps each: what a step sees again, and what share of its ink is new."""
    e = tables.table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 8).alias("segment"), F.posexplode(attention(F.col("embedding"))).alias("pos", "x"))
    before = Window.partitionBy("segment", "pos").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumns({"prev": F.coalesce(F.max("x").over(before), F.lit(0.0)), "ink": (F.col("pos") % 7) / 7.0})
    new = F.greatest(F.col("x") - F.col("prev"), F.lit(0.0))
    g = e.groupBy("segment", "vec_id").agg(F.sum(F.least("x", "prev")).alias("reused"), F.sum(new * F.col("ink")).alias("gain"), F.sum(F.col("x") * F.col("ink")).alias("seen"), F.sum(new).alias("novel"))
    ratio = F.when(F.col("seen") > 0, F.col("gain") / F.greatest("seen", F.lit(1e-8))).otherwise(F.col("novel"))
    return g.select("segment", "vec_id", F.round("reused", 6).alias("reused"), F.round("gain", 6).alias("gain"), F.round(ratio, 6).alias("novel_ratio"))


W11 = f"""WITH {ATT}, e AS (SELECT vec_id, vec_id // 8 AS segment, unnest(range(len(a))) AS pos, unnest(a) AS x FROM att),
p AS (SELECT *, coalesce(max(x) OVER (PARTITION BY segment, pos ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev, pos % 7 / 7.0::DOUBLE AS ink FROM e),
g AS (SELECT segment, vec_id, sum(least(x, prev)) AS reused, sum(greatest(x - prev, 0) * ink) AS gain, sum(x * ink) AS seen, sum(greatest(x - prev, 0)) AS novel FROM p GROUP BY segment, vec_id)
SELECT segment, vec_id, round(reused, 6) AS reused, round(gain, 6) AS gain, round(CASE WHEN seen > 0 THEN gain / greatest(seen, 1e-8) ELSE novel END, 6) AS novel_ratio FROM g"""


def trace(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))


def trailing(spark: SparkSession, sf: str) -> DataFrame:
    return trace(spark, sf).select("vec_id", traces.trailing_run(F.transform("v", lambda x: x < 0.15)).alias("run"))


W9 = "SELECT vec_id, (64 - coalesce(list_max(list_filter(range(1, 65), lambda i: abs(embedding[i]::DOUBLE) >= 0.15)), 0))::BIGINT AS run FROM embeddings"


def smoothed(spark: SparkSession, sf: str) -> DataFrame:
    a = trace(spark, sf).select("vec_id", F.posexplode(traces.moving_average(F.col("v"), 5)).alias("pos", "x"))
    return a.select("vec_id", "pos", F.round("x", 6).alias("x"))


W12 = """SELECT vec_id, i::INT AS pos, round(list_sum(list_transform(embedding[greatest(i - 1, 1):least(i + 3, 64)], lambda x: abs(x::DOUBLE))) / 5, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)"""


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Probability falls and support fades along the trace of every second vector, and the centre stands at its end."""
    n, odd = 64, F.col("vec_id") % 2 == 1
    t = trace(spark, sf)
    p = F.transform("v", lambda x, i: F.least(F.lit(1.0), F.when(odd & (i >= 48), x).otherwise(0.7 + x)))
    s = F.transform("v", lambda x, i: F.when(odd & (i >= 48), x / 10).otherwise(0.2 + x))
    c = F.transform("v", lambda x, i: F.when(odd & (i >= 48), F.lit(0.95)).otherwise(i / n))
    t = t.select("vec_id", p.alias("p"), s.alias("s"), c.alias("c"), F.lit(0.9).alias("last_ink"), F.lit(None).cast("long").alias("near_loop"))
    return grounds.decide(t).select("vec_id", "reason", "start")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """A reading of 64 characters for each vector, two of three with a stretch that is weak and that attention stands over."""
    i, at = F.col("vec_id"), (14 + F.col("vec_id") % 20)
    inside = lambda k: (F.col("vec_id") % 3 > 0) & (k >= at) & (k < at + 6 + F.col("vec_id") % 17)
    text = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when((k + i) % 7 == 6, F.lit(" ")).when((i % 4 == 0) & (k % 9 == 4), F.lit("5")).otherwise(F.char(97 + k % 26)))
    return trace(spark, sf).select(
        "vec_id", F.array_join(text, "").alias("text"), F.transform("v", lambda x, k: F.when(inside(k), 0.3 + x / 4).otherwise(0.85 + x / 10)).alias("p"),
        F.transform("v", lambda x, k: F.when(inside(k), at / 64 + x / 50).otherwise(k / 64)).alias("c"), F.transform("v", lambda x, k: F.when(inside(k), x / 8).otherwise(0.3 + x / 4)).alias("s"),
    )


def midline(spark: SparkSession, sf: str) -> DataFrame:
    found = spans.amid(grounds.floors(readings(spark, sf))).where("span is not null")
    return found.select("vec_id", F.col("span.start").cast("long").alias("start"), F.col("span.end").cast("long").alias("end"), F.round("span.score", 6).alias("score"), spans.without(F.col("text"), F.col("span.start"), F.col("span.end")).alias("kept"))


READINGS = """chars AS (SELECT vec_id, k, CASE WHEN (k + vec_id) % 7 = 6 THEN ' ' WHEN vec_id % 4 = 0 AND k % 9 = 4 THEN '5' ELSE chr((97 + k % 26)::INT) END AS ch,
  CASE WHEN i THEN 0.3 + v / 4 ELSE 0.85 + v / 10 END AS p, CASE WHEN i THEN (14 + vec_id % 20) / 64.0::DOUBLE + v / 50 ELSE k / 64.0::DOUBLE END AS c, CASE WHEN i THEN v / 8 ELSE 0.3 + v / 4 END AS s FROM (
  SELECT *, vec_id % 3 > 0 AND k >= 14 + vec_id % 20 AND k < 20 + vec_id % 20 + vec_id % 17 AS i FROM (SELECT vec_id, unnest(range(64)) AS k, abs(unnest(embedding)::DOUBLE) AS v FROM embeddings)))"""
D15 = f"""WITH {READINGS},
floors AS (SELECT vec_id, least(0.72, greatest(0.56, 0.68 * median(p))) AS pf, least(0.18, greatest(0.10, 0.28 * median(s))) AS sf FROM chars WHERE k < 58 GROUP BY vec_id),
words AS (SELECT vec_id, g, min(k) AS a, max(k) + 1 AS b, avg(p) AS p, avg(s) AS s, avg(c) AS c FROM (SELECT *, k - row_number() OVER (PARTITION BY vec_id ORDER BY k) AS g FROM chars WHERE ch <> ' ') GROUP BY vec_id, g),
flagged AS (SELECT w.*, pf, sf, p <= least(0.72, pf + 0.10) AND s <= least(0.18, 1.25 * sf) AS weak, row_number() OVER (PARTITION BY vec_id ORDER BY a) AS n,
  avg(p) OVER l AS lp, avg(s) OVER l AS ls, avg(c) OVER l AS lc, avg(p) OVER r AS rp, avg(s) OVER r AS rs, avg(c) OVER r AS rc FROM words w JOIN floors USING (vec_id)
  WINDOW l AS (PARTITION BY vec_id ORDER BY a ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY vec_id ORDER BY a ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
runs AS (SELECT vec_id, any_value(pf) AS pf, any_value(sf) AS sf, count(*) AS n, min(a) AS a, max(b) AS b, avg(p) AS p, avg(s) AS s, avg(c) AS c, arg_min(lp, a) AS lp, arg_min(ls, a) AS ls, arg_min(lc, a) AS lc, arg_max(rp, a) AS rp, arg_max(rs, a) AS rs, arg_max(rc, a) AS rc
  FROM (SELECT *, n - row_number() OVER (PARTITION BY vec_id, weak ORDER BY n) AS run FROM flagged) WHERE weak GROUP BY vec_id, run),
ranged AS (SELECT r.*, (SELECT max(c) - min(c) FROM chars x WHERE x.vec_id = r.vec_id AND x.k >= r.a AND x.k < r.b) AS spread, (SELECT c FROM chars x WHERE x.vec_id = r.vec_id AND x.k = r.b - 1) - (SELECT c FROM chars x WHERE x.vec_id = r.vec_id AND x.k = r.a) AS progress FROM runs r),
fit AS (SELECT *, least(ls, rs) - s + least(lp, rp) - p + greatest(0, rc - lc) + greatest(0, rc - c) - spread AS score FROM ranged
  WHERE lp IS NOT NULL AND rp IS NOT NULL AND n <= 12 AND a >= 8 AND 64 - b >= 6 AND (b - a) / 64.0::DOUBLE <= 0.55
  AND least(lp, rp) >= greatest(pf, 1.2 * p) AND least(ls, rs) >= greatest(sf, 1.8 * s) AND (spread <= 0.12 OR abs(progress) <= 0.04) AND (least(abs(c - lc), abs(c - rc)) <= 0.10 OR rc - c >= 0.05)
  AND rc - lc >= 0.08 AND rc >= c - 0.10 AND s <= 0.55 * least(ls, rs) AND p <= 0.82 * least(lp, rp)),
texts AS (SELECT vec_id, string_agg(ch, '' ORDER BY k) AS t FROM chars GROUP BY vec_id)
SELECT vec_id, a AS start, b AS "end", round(score, 6) AS score, trim(rtrim(t[1:a]) || ' ' || ltrim(t[b + 1:64])) AS kept FROM fit JOIN texts USING (vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, a) = 1"""


def ended(spark: SparkSession, sf: str) -> DataFrame:
    """Readings that are trimmed from their fifth word on, with weak words in the same place of the image before it."""
    at = F.length(F.regexp_extract("text", r"^(?:\S*\s+){4}", 0)).cast("long")
    rows = grounds.floors(readings(spark, sf)).withColumns({"start": at, "last_ink": F.lit(0.4)})
    rows = rows.withColumn("c", F.transform("c", lambda x, k: F.when(k >= at - 12, 0.4 + k / 1000 + x / 100).otherwise(x))).withColumn("s", F.transform("s", lambda x, k: F.when(k >= at - 12, x / 4).otherwise(x)))
    rows = rows.withColumn("p", F.transform("p", lambda x, k: F.when((k >= at - 12) & (F.col("vec_id") % 5 > 0), x * 0.7).otherwise(x)))
    return spans.expanded(rows).select("vec_id", "start", "taken")


def evidence_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Ends without ground and spans amid the line; every fourth reading loses its ground at its 40th character."""
    gone = lambda k: (F.col("vec_id") % 4 == 1) & (k >= 40)
    rows = readings(spark, sf).withColumns({"p": F.transform("p", lambda x, k: F.when(gone(k), x / 4).otherwise(x)), "s": F.transform("s", lambda x, k: F.when(gone(k), x / 20).otherwise(x)), "c": F.transform("c", lambda x, k: F.when(gone(k), 0.7 + x / 100).otherwise(x))})
    out = spans.cuts(rows.withColumns({"last_ink": F.lit(0.75), "near_loop": F.lit(None).cast("long")}))
    return out.where("reason is not null").select("vec_id", "reason", "kind", "start", "end", "taken", "kept", "removed", "numeric")


QUERIES = {
    "n7_attention_centre_spread": (centre_spread, N7),
    "a20_ink_profile": (ink_profile, A20),
    "a14_adaptive_thresholds": (thresholds, A14),
    "n12_hallucination_risk": (hallucination, N12),
    "w11_visual_grounding": (grounding, W11),
    "w9_trailing_unsupported": (trailing, W9),
    "w12_moving_average": (smoothed, W12),
    "d14_decoder_evidence": (evidence, None),
    "d15_midline_spans": (midline, D15),
    "w13_cluster_expansion": (ended, None),
    "d14_d15_w13_cuts": (evidence_cuts, None),
}
