"""Mixing sources to target weights as a time-varying curriculum.

Every source has a target number of words. Its share of the training stream is a schedule that changes in time: its
rate falls or rises linearly from `1 + tilt` to `1 - tilt` times its mean over the time from 0 to 1, with `tilt`
between -`slope` and `slope` by the source's rank, so its cumulative demand is the schedule's integral. A source is
read in an order of digests, as often as its target asks; the words read before a copy of a document are inverted
through the cumulative demand, which gives the copy's position in time. Copies are range-sorted by position.

Defined cases: a null or empty text has size 0, takes no words and trains nothing; sources go by code point and null
is the last, apart from the empty one; ties and repeated rows are ordered by the digest of doc_id and text, then stand
side by side; a null doc_id is mixed like any other; an empty table gives no rows; other columns pass through
`curriculum`, where their values tell rows of one doc_id apart. The document at the end of a source's target gives only
the words that are still asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsafe.llm import _shared

SPACE = " \\t\\n\\x0B\\f\\r"
WEIGHTS = (1, 2, 3)
MOST = 3
SLOPE = 0.5


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, rank: one row for each source of sized (source, size).

    A source is at its ceiling if the words left after all sources with a lower ceiling for their weight, dealt by
    weight, would reach it; the ceilings taken in that order are a prefix, so one running sum settles the resharing.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    ranked = totals.withColumn("rank", rank).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    by_ceiling = Window.orderBy((F.col("cap") / F.col("w")), "rank")
    before = by_ceiling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumns({
        "left_words": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    }).withColumn("full", F.col("left_words") * F.col("w") >= F.col("cap") * F.col("left_w"))
    full = F.col("full")
    spent = ranked.withColumns({
        "words": F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(full, F.col("cap"))).over(everything), F.lit(0)),
        "ws": F.coalesce(F.sum(F.when(~full, F.col("w"))).over(everything), F.lit(0)),
    })
    target = F.when(full, F.col("cap").cast("double")).otherwise((F.col("words") * F.col("w")).cast("double") / F.col("ws").cast("double"))
    return spent.select("source", "source_size", target.alias("target"), "rank")


def position(done: Column, target: Column, tilt: Column) -> Column:
    """The time at which a source's cumulative demand target * ((1 + tilt) t - tilt t^2) reaches done."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / target))
    curved = ((1 + tilt) - F.sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * share)) / (2 * tilt)
    return F.when(F.abs(tilt) < 1e-9, share).otherwise(curved)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, slope: float = SLOPE, row: Column | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, source, text): doc_id, source, size, source_size, target, taken, and copies:
    an array of (position, words), one for each time the document is read. row: a long that tells rows of one doc_id
    apart, which comes out as row."""
    digest = F.sha2(F.concat_ws("\x00", F.col("doc_id").cast("string"), F.coalesce(F.md5("text"), F.lit("-"))), 256)
    extra = [] if row is None else [row.alias("row")]
    sized = docs.select("doc_id", "source", size(F.col("text")).alias("size"), (digest if row is None else F.concat(digest, F.hex(row))).alias("_digest"), *extra)
    sized = _shared.written(sized, "sizes")
    wanted = targets(sized, weights, most)
    placed = _shared.running(sized, ["source"], F.col("_digest"), F.col("size"), "_before", sized.count()).drop("_digest")
    sources = wanted.withColumnRenamed("source", "_s")
    # a row for each source; broadcast below Catalyst's own threshold, else shuffled
    joined = placed.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    asked = F.round("target").cast("long")
    tilt = F.lit(slope) * (F.pmod(F.col("rank"), F.lit(3)) - 1)
    copy = lambda k: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), asked - k * F.col("source_size") - F.col("_before")))
    when = lambda k: position(k * F.col("source_size") + F.col("_before") + copy(k) / 2, F.col("target"), tilt)
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.struct(when(k).alias("position"), copy(k).alias("words"))), lambda c: c["words"] > 0)
    out = joined.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", *(["row"] if extra else []))


def identity(docs: DataFrame) -> Column:
    """64 bits of all columns of a row; rows that agree in them and in doc_id are taken to be the same."""
    flat = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`")
    cells = [x for f in docs.schema.fields for x in (flat(f), F.col(f"`{f.name}`").isNull())]
    return F.xxhash64(*cells)


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs, a row for each copy that the mix reads, range-sorted by position. A copy that is cut ends
    after its last word that is asked for."""
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    at = {c: f"_c{i}" for i, c in enumerate(columns)}
    plan = mix(docs, row=identity(docs), **how).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "size", "copies")
    # equal rows are one: their copies are read from the one row that stands for them
    plan = plan.groupBy("_doc", "_row", "size").agg(F.flatten(F.collect_list("copies")).alias("_copies"), F.count("*").alias("_n")).withColumnRenamed("size", "_size")
    plan = _shared.written(plan.where(F.size("_copies") > 0), "plan")
    same = F.col(at["doc_id"]).eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_row"))
    keyed = named.withColumn("_own", identity(named))
    read = keyed.join(plan, same)
    if not plan.where("_n > 1").isEmpty():
        whole = [*at.values(), "_size", "_copies"]
        once = read.where("_n > 1").groupBy("_doc", "_row").agg(*[F.first(c).alias(c) for c in whole])
        read = read.where("_n = 1").select(*whole).unionByName(once.select(*whole))
    read = read.withColumn("_copy", F.explode("_copies"))
    text = F.col(at["text"])
    cut = F.when(F.col("_copy.words") >= F.col("_size"), text).otherwise(F.array_join(F.slice(F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), f"[{SPACE}]+"), F.lit(1), F.col("_copy.words").cast("int")), " "))
    read = read.withColumn(at["text"], cut)
    by = [F.col("_copy.position"), F.xxhash64(at["doc_id"])]
    return read.repartitionByRange(*by).sortWithinPartitions(*by).select(*[F.col(v).alias(k) for k, v in at.items()])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    plan = mix(docs)
    first = F.try_element_at("copies", F.lit(1))["position"]
    # documents that the mix does not read have no position; their hashes spread them over the ranges that hold nulls
    by = [F.col("position"), F.xxhash64("doc_id")]
    return plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).repartitionByRange(*by).sortWithinPartitions(*by)


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^ \t\n\x0B\f\r]+', chr(1), 'g'), '[ \t\n\x0B\f\r]+', '', 'g')), 0)::BIGINT AS size,
         sha256(doc_id::VARCHAR || chr(0) || coalesce(md5(text), '-')) AS digest
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM ranked),
dealt AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
  FROM weighed),
marked AS (SELECT *, left_words * w >= cap * left_w AS is_full FROM dealt),
targets AS (
  SELECT source, source_size, rank,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE ((sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * w)::DOUBLE
                   / (coalesce(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), 0))::DOUBLE END AS target
  FROM marked),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(0, least(size, round(target)::BIGINT - before)) AS c0,
         greatest(0, least(size, round(target)::BIGINT - source_size - before)) AS c1,
         greatest(0, least(size, round(target)::BIGINT - 2 * source_size - before)) AS c2
  FROM placed),
timed AS (
  SELECT *, 0.5::DOUBLE * (rank % 3 - 1) AS tilt,
         CASE WHEN c0 > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (before + c0 / 2) / target)) END AS share
  FROM taken)
SELECT doc_id, size, source_size, target, (c0 + c1 + c2)::BIGINT AS taken,
       CASE WHEN abs(tilt) < 1e-9 THEN share
            ELSE ((1 + tilt) - sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * share)) / (2 * tilt) END AS position
FROM timed
"""
