"""Which rows of a page or document are looked at again: the first of an order, and what comes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsafe.functions import decisions as D


def first_of(rows: DataFrame, keys: list[str], order: list, most: int, into: str = "rank") -> DataFrame:
    """The first `most` rows of every key in an order that must not tie, with their rank from 1; 0 is without limit."""
    ranked = rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(into) <= most) if most else ranked


def seeds(rows: DataFrame, most: int = 8, full: bool = False) -> DataFrame:
    """Lines (doc_id, line_no, score) whose decoder evidence is taken, best score first; all of them where `most` is 0 or
    full coverage is asked for."""
    return first_of(rows, ["doc_id"], [F.desc("score"), "line_no"], 0 if full else most)


def remediation(lines: DataFrame, most: int = 8) -> DataFrame:
    """High-risk lines (doc_id, line_no, conf, risk, reasons) that are tried again: numeric disagreements first, then the
    least sure."""
    numeric = F.array_contains("reasons", "tesseract_numeric_disagreement")
    return first_of(lines.where("risk = 'high'"), ["doc_id"], [(~numeric).cast("int"), "conf", "line_no"], most)


def headings(lines: DataFrame, labels: list[str], most: int = 2) -> DataFrame:
    """The first lines of a page that are a heading's label alone."""
    return first_of(lines.where(D.heading(F.col("text"), labels) == "incomplete"), ["doc_id"], ["line_no"], most)


def beams(loops: DataFrame, most: int = 1) -> DataFrame:
    """Looping segments (doc_id, line_no, repeats, partial, ngram, conf) that a beam reads again: the worst, then the least
    sure."""
    return first_of(loops, ["doc_id"], [F.desc("repeats"), F.desc("partial"), F.desc("ngram"), "conf", "line_no"], most)


def tails(segments: DataFrame, most: int = 2) -> DataFrame:
    """Suspicious tails (doc_id, line_no, blank, conf) that are read again: the emptiest, then the least sure, then the last."""
    return first_of(segments, ["doc_id"], [F.desc("blank"), "conf", F.desc("line_no")], most)


def guards(segments: DataFrame, least: float, most: int = 4) -> DataFrame:
    """Segments (doc_id, line_no, risk) whose risk of invention reaches `least`, highest first."""
    return first_of(segments.where(F.col("risk") >= least), ["doc_id"], [F.desc("risk"), "line_no"], most)


def longest_tail(candidates: DataFrame, key: str) -> DataFrame:
    """Of the candidates (key, place, words, score) of a key the longest, then the surest; the first of equals."""
    best = F.max_by(F.struct("place", "words", "score"), F.struct("words", "score", -F.col("place")))
    return candidates.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def cut_choice(candidates: DataFrame, key: str, desired: Column) -> DataFrame:
    """Of the candidates (key, cut, run, ink) for a cut the nearest to where it is wanted, then that of the widest blank
    run, then of the least ink."""
    best = F.min_by(F.struct("cut", "run", "ink"), F.struct(F.abs(F.col("cut") - desired), -F.col("run"), F.col("ink"), F.col("cut")))
    return candidates.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def refined_headings(lines: DataFrame, retried: DataFrame, labels: list[str], most: int = 2) -> DataFrame:
    """lines (doc_id, line_no, text, conf, error_code, risk, reasons) after the retry (doc_id, line_no, new_text, new_conf,
    new_error) of their bare headings: a whole heading that is sure enough replaces the line, with its own code; else a line
    without a code becomes a high risk. Lines beyond the first `most` bare ones of a page are left as they are."""
    tried = headings(lines, labels, most).select("doc_id", "line_no", F.lit(True).alias("_tried"))
    rows = lines.join(tried, ["doc_id", "line_no"], "left").join(retried, ["doc_id", "line_no"], "left")
    good = F.coalesce(D.heading_accepted(F.col("new_text"), F.col("new_error"), F.col("new_conf"), F.col("conf"), labels), F.lit(False))
    taken = F.col("_tried").isNotNull() & good
    failed = F.col("_tried").isNotNull() & ~good & F.col("error_code").isNull()
    mark = F.lit("chapter_heading_incomplete")
    out = rows.select(
        "doc_id", "line_no", F.when(taken, F.col("new_text")).otherwise(F.col("text")).alias("text"), F.when(taken, F.col("new_conf")).otherwise(F.col("conf")).alias("conf"),
        F.when(failed, mark).when(taken, F.lit(None).cast("string")).otherwise(F.col("error_code")).alias("error_code"),
        F.when(taken, F.lit("none")).when(failed, F.lit("high")).otherwise(F.col("risk")).alias("risk"),
        F.when(taken, F.array().cast("array<string>")).when(failed, D.reason_union(F.col("reasons"), F.array(mark))).otherwise(F.col("reasons")).alias("reasons"),
    )
    return out


def review_list(lines: DataFrame, labels: dict[str, str]) -> DataFrame:
    """High-risk lines (document, page_index, line_no, text, conf, risk, reasons, verifier, v_conf) as a reader sees them."""
    named = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, v)]) if labels else F.lit(None).cast("map<string,string>")
    sure = lambda c: F.format_string("%.3f", F.coalesce(c, F.lit(0.0)))
    text = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit("[trống]")).otherwise(F.col("text"))
    verifier = F.when(F.coalesce(F.col("verifier"), F.lit("")) == "", F.lit("Tesseract: không có dòng đối chiếu")).otherwise(F.concat(F.lit("Tesseract ("), sure(F.col("v_conf")), F.lit("): "), "verifier"))
    return lines.where("risk = 'high'").select(
        "document", "page_index", "line_no", F.format_string("Trang %d · dòng %d", F.col("page_index") + 1, F.col("line_no") + 1).alias("heading"),
        F.array_join(F.transform("reasons", lambda r: F.coalesce(F.element_at(named, r), r)), " · ").alias("reasons"),
        F.concat(F.lit("OCR chính ("), sure(F.col("conf")), F.lit("): "), text).alias("primary"), verifier.alias("verifier"),
    )
