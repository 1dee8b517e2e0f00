"""Views over the Parquet tables that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text, conf: a line of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return docs.withColumn("conf", ((F.col("doc_id") * 31 + F.col("line_no") * 17) % 100) / 100.0)


LINES = """lines AS (SELECT doc_id, line_no, text, ((doc_id * 31 + line_no * 17) % 100) / 100.0::DOUBLE AS conf FROM (
  SELECT doc_id, unnest(range(len(l)))::INT AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, line, x0, y0, x1, y1, conf: boxes of lines laid out from lineitem."""
    t = table(spark, sf_dir, "lineitem")
    x0 = ((F.col("l_partkey") * 7) % 1600).cast("double")
    y0 = (F.col("l_linenumber") * 40 + F.col("l_suppkey") % 7).cast("double")
    return t.select(
        F.floor(F.col("l_orderkey") / 64).alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 40 + 20 * F.col("l_quantity")).alias("x1"), (y0 + 20 + F.col("l_linenumber") % 5).alias("y1"), ((F.col("l_partkey") % 100) / 100.0).alias("conf"),
    )


BOXES = """boxes AS (SELECT l_orderkey // 64 AS page, l_orderkey * 8 + l_linenumber AS line, ((l_partkey * 7) % 1600)::DOUBLE AS x0,
  (l_linenumber * 40 + l_suppkey % 7)::DOUBLE AS y0, ((l_partkey * 7) % 1600)::DOUBLE + 40 + 20 * l_quantity AS x1,
  (l_linenumber * 40 + l_suppkey % 7)::DOUBLE + 20 + l_linenumber % 5 AS y1, (l_partkey % 100) / 100.0::DOUBLE AS conf FROM lineitem)"""


def _printed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    return docs, F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 16).cast("int")), lambda i: F.array_join(F.slice("w", i * 16 + 1, 16), " "))


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text, conf: texts as printed, sixteen words a line, since a line on paper has a bounded length."""
    docs, rows = _printed(spark, sf_dir)
    out = docs.select("doc_id", F.posexplode(rows).alias("line_no", "text"))
    return out.withColumn("conf", ((F.col("doc_id") * 31 + F.col("line_no") * 17) % 100) / 100.0)


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text, after: lines as printed and the next line of the same document, null after the last."""
    docs, rows = _printed(spark, sf_dir)
    both = F.zip_with("rows", F.slice("rows", F.lit(2), F.size("rows")), lambda a, b: F.struct(a.alias("text"), b.alias("after")))
    return docs.select("doc_id", rows.alias("rows")).select("doc_id", F.posexplode(both).alias("line_no", "x")).select("doc_id", "line_no", "x.text", "x.after")


PRINTED = r"""lines AS (SELECT doc_id, i::INT AS line_no, array_to_string(w[i * 16 + 1:i * 16 + 16], ' ') AS text, ((doc_id * 31 + i * 17) % 100) / 100.0::DOUBLE AS conf FROM (
  SELECT doc_id, w, unnest(range((len(w) + 15) // 16)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)))"""
