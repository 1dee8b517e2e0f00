"""Counts and times of pages: what was done, how long it took, and what of it is accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages whose times add up to the accounted part of a recogniser's wall time. Fixed values.
STAGES = ("greedy", "decoder_evidence", "guard_retry", "tail_retry", "beam_retry", "cross_segment_analysis", "secondary_verifier", "semantic_verification")


def page_total(metrics: Column) -> Column:
    """Sum of the times of a map of metrics; the time of a recognition window is shared by pages and left out."""
    timed = F.filter(F.map_entries(metrics), lambda e: F.endswith(e["key"], F.lit("_ms")) & (e["key"] != "recognition_window_ms"))
    return F.round(F.aggregate(timed, F.lit(0.0), lambda s, e: s + F.coalesce(e["value"], F.lit(0.0))), 3)


def accounted(wall: Column, cpu: Column, resolve: Column, *stages: Column) -> dict[str, Column]:
    """cpu_wall_ratio, accounted_wall_ms and unaccounted_wall_ms, which is never below 0."""
    total = sum((F.coalesce(s, F.lit(0.0)) for s in stages), F.lit(0.0))
    return {
        "cpu_wall_ratio": F.round(cpu / F.greatest(wall, F.lit(1e-9)), 4),
        "accounted_wall_ms": F.round(total + resolve, 3),
        "unaccounted_wall_ms": F.round(F.greatest(F.lit(0.0), wall - total - resolve), 3),
    }


def semantic_counters(lines: DataFrame) -> DataFrame:
    """A row a page (document, page_index) with the counters of its lines (candidate, verified, unavailable, trimmed, risk,
    eligible, attempted, applied); lines that are no candidates count as skipped."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    flag = F.col
    return lines.groupBy("document", "page_index").agg(
        count(flag("candidate")).alias("candidate_count"), (F.count("*") - count(flag("candidate"))).alias("skipped_count"), count(flag("verified")).alias("verified_count"),
        count(flag("unavailable")).alias("secondary_unavailable_count"), count(flag("trimmed")).alias("auto_trimmed_count"), count(flag("risk") == "high").alias("high_risk_count"),
        count(flag("eligible")).alias("retry_eligible_count"), count(flag("attempted")).alias("retry_attempted_count"), count(flag("applied")).alias("retry_applied_count"),
    )


def line_confidence(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, confidence: the least probability of the segments (text, p) of a line that have text; 0 without one."""
    return segments.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("text") != "", F.col("p"))), F.lit(0.0)).alias("confidence"))


def low_ink_pages(pages: DataFrame) -> DataFrame:
    """The results of pages (page_index, reason) that have too little ink to be read: no lines, one marker, one risk."""
    reasons = F.array(F.lit("empty_ocr_text"), F.lit("low_ink_page"))
    marker = F.format_string("[OCR_SEMANTIC_RISK page=%d line=0 reasons=%s]", F.col("page_index") + 1, F.array_join(reasons, ","))
    return pages.select(
        "page_index", F.lit("").alias("text"), marker.alias("safe_text"), F.coalesce("reason", F.lit("low_ink")).alias("reason"), F.lit(0).cast("long").alias("line_count"),
        F.lit(1).cast("long").alias("risk_count"), F.array(F.lit("empty_ocr_text")).alias("error_codes"), reasons.alias("reasons"), F.lit(True).alias("needs_review"), F.lit(False).alias("ready"),
    )


def report(events: DataFrame) -> DataFrame:
    """section, key, stat, value: the figures of a log report in long form. events: event_type, value."""
    stats = events.groupBy("event_type").agg(F.count("*").cast("double").alias("count"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    long = stats.unpivot(["event_type"], ["count", "mean", "max"], "stat", "value")
    return long.select(F.lit("stages").alias("section"), F.col("event_type").alias("key"), "stat", F.round("value", 4).alias("value"))
