"""Lines to pages, pages to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsafe.functions import decisions as D
from docsafe.functions import text as T


def ordered_join(order: str, value: str, separator: str) -> F.Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), separator)


def judged_lines(lines: DataFrame) -> DataFrame:
    """lines (document, page_index, line_no, text, conf, error_code) with risk, reasons and the safe text."""
    empty = T.strip(F.col("text")) == ""
    loop = T.char_loop_start(F.col("text")) > 0
    risky = F.col("error_code").isNotNull() | (F.col("conf") < 0.62)
    risk = F.when(empty | risky, F.lit("high")).when(loop, F.lit("medium")).otherwise(F.lit("none"))
    reasons = F.array_compact(F.array(F.when(empty, F.lit("empty_primary_text")), F.when(~empty & risky, F.lit("primary_recognition_risk")), F.when(loop, F.lit("decoder_loop"))))
    out = lines.withColumns({"risk": risk, "reasons": reasons})
    return out.withColumn("safe_text", D.safe_line(F.col("text"), F.col("risk"), F.col("page_index"), F.col("line_no"), F.col("reasons")))


def pages(judged: DataFrame) -> DataFrame:
    """One row a page: text, the safe channel, mean confidence, codes, counts and whether a reader should look."""
    full = T.strip(F.col("text")) != ""
    text = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: T.strip(x["text"]) != ""), lambda x: x["text"]), "\n")
    out = judged.groupBy("document", "page_index").agg(
        text.alias("text"), ordered_join("line_no", "safe_text", "\n").alias("safe_text"),
        F.round(F.avg(F.when(full, F.col("conf"))), 4).alias("confidence_mean"), F.count("*").alias("line_count"),
        F.count_if(F.col("risk") == "high").alias("risk_count"),
        F.collect_set("error_code").alias("_codes"),
        F.coalesce(F.bool_or(F.col("error_code").isNotNull() | (F.col("risk") != "none") | (full & (F.col("conf") < 0.80))), F.lit(False)).alias("_review"),
    )
    extra = F.array_compact(F.array(F.when(F.col("risk_count") > 0, F.lit("semantic_risk_detected")), F.when(F.col("text") == "", F.lit("empty_ocr_text"))))
    return out.withColumns({"error_codes": F.array_sort(F.array_distinct(F.concat("_codes", extra))), "needs_review": F.col("_review") | (F.col("text") == ""), "ready": F.col("risk_count") == 0}).drop("_codes", "_review")


def documents(pages: DataFrame) -> DataFrame:
    """One row a document: marked page texts in order, both channels, counts and status."""
    marked = pages.withColumns({
        "_t": F.concat(F.lit("===== Trang "), (F.col("page_index") + 1).cast("string"), F.lit(" =====\n"), "text"),
        "_s": F.concat(F.lit("===== Trang "), (F.col("page_index") + 1).cast("string"), F.lit(" =====\n"), "safe_text"),
    })
    out = marked.groupBy("document").agg(
        F.count("*").alias("page_count"), F.sum("line_count").alias("line_count"), F.sum("risk_count").alias("risk_count"), F.bool_and("ready").alias("ready"),
        F.bool_or(F.size("error_codes") > 0).alias("_codes"), ordered_join("page_index", "_t", "\n\n").alias("text"), ordered_join("page_index", "_s", "\n\n").alias("safe_text"),
    )
    return out.withColumns({"status": F.when(F.col("_codes") | ~F.col("ready"), F.lit("partial")).otherwise(F.lit("complete")), "warnings": F.when(F.col("risk_count") > 0, F.lit("semantic_review_required")).otherwise(F.lit(""))}).drop("_codes")
