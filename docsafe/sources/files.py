"""Readers of recognition payloads, verifier tables, logs and uploads; writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsafe.functions import text as T


def uploads(spark: SparkSession, path: str, most: int = 50 << 20) -> DataFrame:
    """path, name, length, sha256, error_code of every file: null for a PDF that may be read."""
    return checked_uploads(spark.read.format("binaryFile").load(path), most)


def document_name(path):
    """The last part of a path; document.pdf without one."""
    return F.coalesce(F.nullif(F.regexp_extract(F.rtrim(path, F.lit("/")), "[^/]+$", 0), F.lit("")), F.lit("document.pdf"))


def is_pdf_name(name):
    return F.endswith(F.lower(name), F.lit(".pdf"))


def checked_uploads(files: DataFrame, most: int) -> DataFrame:
    return files.select("path", document_name(F.col("path")).alias("name"), "length", F.sha2("content", 256).alias("sha256"), upload_error(F.col("content"), F.col("length"), most).alias("error_code"))


def upload_error(content, length, most: int):
    return F.when(length == 0, F.lit("empty_upload")).when(F.substring(content, 1, 5) != F.lit(b"%PDF-"), F.lit("invalid_pdf")).when(length > most, F.lit("pdf_too_large"))


def log_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects, one a line; blank lines, other text and malformed objects are left out."""
    return parsed_events(spark.read.text(path), schema)


def parsed_events(lines: DataFrame, schema: str) -> DataFrame:
    raw = lines.select(T.strip(F.col("value")).alias("value")).where(F.startswith("value", F.lit("{")))
    parsed = raw.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return parsed.where("e._bad is null").select("e.*").drop("_bad")


#: Columns of a verifier's table. Fixed values.
TSV = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def verifier_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of tab-separated verifier tables, in the order of their lines."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("position"))
    return parsed_words(lines.where(~F.startswith("value", F.lit("level\t"))))


def parsed_words(lines: DataFrame) -> DataFrame:
    """lines (value, position) of verifier tables without quoting as words: blank texts, negative or missing confidences and
    rows that cannot be read are left out."""
    cell = lambda name: F.get("cells", F.lit(TSV.index(name)))
    rows = lines.select("position", F.split("value", "\t").alias("cells"))
    whole = [cell(c).try_cast("long").alias(c) for c in ("page_num", "block_num", "par_num", "line_num")]
    real = [cell(c).try_cast("double").alias(c) for c in ("left", "top", "width", "height")]
    sure = F.when(F.coalesce(cell("conf"), F.lit("")) == "", F.lit(-1.0)).otherwise(cell("conf").try_cast("double"))
    out = rows.select("position", *whole, *real, sure.alias("conf"), T.strip(cell("text")).alias("text"))
    return out.where("text <> '' and conf >= 0").dropna(subset=["page_num", "block_num", "par_num", "line_num", "left", "top", "width", "height"])


def verifier_lines(words: DataFrame) -> DataFrame:
    """Words to lines by page, block, paragraph and line: text in input order, confidence by length, the box around all."""
    n = F.greatest(F.length("text"), F.lit(1))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.col("conf") / 100 * n) / F.sum(n)))
    return words.groupBy("page_num", "block_num", "par_num", "line_num").agg(
        F.array_join(ordered, " ").alias("text"), F.round(sure, 9).alias("confidence"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1")
    )


def detector_polygons(payloads: DataFrame) -> DataFrame:
    """page_index, polygon, points, score from JSON payloads that name them one way or the other; a missing score is 1."""
    shape = "dt_polys array<array<array<double>>>, polys array<array<array<double>>>, dt_scores array<double>, scores array<double>"
    p = payloads.select("page_index", F.from_json("payload", shape).alias("p"))
    polys, scores = F.coalesce("p.dt_polys", "p.polys"), F.coalesce("p.dt_scores", "p.scores")
    out = p.select("page_index", F.posexplode(polys).alias("polygon", "points"), scores.alias("s"))
    return out.where("size(points) >= 4").select("page_index", "polygon", "points", F.coalesce(F.get("s", F.col("polygon")), F.lit(1.0)).alias("score"))


def terms(spark: SparkSession, path: str, given: list[str]) -> DataFrame:
    return parsed_terms(spark.read.text(path), given).orderBy("rank")


def parsed_terms(lines: DataFrame, given: list[str]) -> DataFrame:
    """term, rank: distinct terms of lines and those given, longest first; blank lines and comments are left out."""
    from pyspark.sql import Window

    own = lines.sparkSession.createDataFrame([(t,) for t in given], "value string")
    all_of = lines.select("value").unionByName(own).select(T.strip(F.col("value")).alias("term")).where("term <> '' and not startswith(term, '#')").distinct()
    return all_of.withColumn("rank", F.row_number().over(Window.orderBy(-F.length("term"), F.lower("term"), "term")))


def result_json(results: DataFrame, columns: list[str], without: list[str] = ()) -> DataFrame:
    """document, value: results as JSON objects of the columns, but for those that a flag leaves out."""
    return results.select("document", F.to_json(F.struct(*[c for c in columns if c not in without])).alias("value"))


def write_results(pages: DataFrame, path: str, with_lines: bool = True) -> None:
    """JSON results, one object a line with the document in it; documents share files."""
    out = pages if with_lines else pages.drop("line_results")
    out.write.json(path)


def secondary_readings(payloads: DataFrame) -> DataFrame:
    """crop_id, text, confidence of JSON payloads that hold them at the top or under res; a missing score is 0."""
    at = lambda name: F.coalesce(F.get_json_object("payload", f"$.res.{name}"), F.get_json_object("payload", f"$.{name}"))
    return payloads.select("crop_id", T.normalized(F.coalesce(at("rec_text"), F.lit(""))).alias("text"), F.coalesce(at("rec_score").try_cast("double"), F.lit(0.0)).alias("confidence"))


def write_texts(documents: DataFrame, path: str) -> None:
    """The audit text, the safe text and the record of every document, in folders of their own."""
    for column in ("text", "safe_text"):
        documents.select("document", F.col(column).alias("value")).write.partitionBy("document").text(f"{path}/{column}")
    documents.select("document", F.to_json(F.struct(*documents.columns), {"pretty": "true"}).alias("value")).write.partitionBy("document").text(f"{path}/audit")


def write_log(events: DataFrame, path: str) -> None:
    """One JSON object a line."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("append").text(path)
