"""Ordered decisions over lines and pages, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsafe.functions import text as T

RISKS = ("none", "medium", "high")


def route(missing: Column, needs_ocr: Column, reason: Column, reasons: Column, markdown: Column, least: int, keep_short: bool = False) -> tuple[Column, Column]:
    """(route, reason) of a page: fallback, ocr or native, in that order of rules."""
    size = F.length(T.strip(F.coalesce(markdown, F.lit(""))))
    short = (size > 0) & (size < least) & F.lit(not keep_short)
    given = F.coalesce(F.when(reason != "", reason), F.when(F.size(reasons) > 0, F.array_join(reasons, ",")), F.lit("pdf_inspector_requires_ocr"))
    where = F.when(missing, F.lit("fallback")).when(needs_ocr, F.lit("ocr")).when(short, F.lit("fallback")).otherwise(F.lit("native"))
    why = F.when(missing, F.lit("native_page_missing")).when(needs_ocr, given).when(short, F.lit("native_text_too_short"))
    return where, why


def fallback(error: Column, text: Column, has_content: Column, reason: Column, least: int) -> tuple[Column, Column]:
    """(route, reason) of a page that the extractor gave up: read errors, long enough texts, empty pages, the rest."""
    enough = F.length(T.strip(F.coalesce(text, F.lit("")))) >= least
    where = F.when(error.isNotNull(), F.lit("ocr")).when(enough | ~has_content, F.lit("native")).otherwise(F.lit("ocr"))
    why = F.when(error.isNotNull(), F.concat(reason, F.lit(";pdfium_text_failure:"), error)).when(enough | ~has_content, reason).otherwise(F.concat(reason, F.lit(";pdfium_text_missing")))
    return where, why


def failed_extraction(enabled: Column, error: Column, policy: Column, text: Column, has_content: Column, least: int) -> tuple[Column, Column]:
    """(route, reason) of a page whose extractor is off or failed with an error "Type:message"; null where neither is so.
    Policies: fail raises, ocr_all reads every page anew, pdfium_then_ocr looks for a text layer first, page by page."""
    reason = F.concat(F.lit("native_failure:"), error)
    enough = F.length(T.strip(F.coalesce(text, F.lit("")))) >= least
    native = (policy == "pdfium_then_ocr") & (enough | ~has_content)
    failed = F.when(policy == "fail", F.raise_error(reason).cast("string"))
    where = F.when(~enabled, F.lit("ocr")).when(error.isNull(), F.lit(None).cast("string")).when(policy == "fail", failed).when(native, F.lit("native")).otherwise(F.lit("ocr"))
    why = F.when(~enabled, F.lit("native_pdf_disabled")).when(error.isNull() | native, F.lit(None).cast("string")).when(policy == "pdfium_then_ocr", F.concat(reason, F.lit(";pdfium_text_missing"))).otherwise(reason)
    return where, why


def quality_action(rotation: Column, width: Column, height: Column, skew: Column) -> Column:
    return F.when(rotation != 0, F.lit("rotate_metadata")).when(width > height, F.lit("orientation_review")).when(F.abs(skew) <= 1.0, F.lit("keep_original")).otherwise(F.lit("deskew_required"))


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "high", 2).when(risk == "medium", 1).otherwise(0)


def risk_max(*risks: Column) -> Column:
    rank = F.greatest(*[risk_rank(r) for r in risks]) if len(risks) > 1 else risk_rank(risks[0])
    return F.element_at(F.array(*[F.lit(r) for r in RISKS]), rank + 1)


def reason_union(*reasons: Column) -> Column:
    return F.array_distinct(F.concat(*reasons))


def safe_line(text: Column, risk: Column, page: Column, line: Column, reasons: Column) -> Column:
    """The text, or for a high risk the mark that stands for it downstream."""
    listed = F.when(F.size(reasons) > 0, F.array_join(reasons, ",")).otherwise(F.lit("unspecified"))
    return F.when(risk == "high", F.format_string("[OCR_SEMANTIC_RISK page=%d line=%d reasons=%s]", page + 1, line + 1, listed)).otherwise(text)


def error_code(empty: Column, numeric: Column, span: Column, loop: Column, insertion: Column, suppressed: Column, uncertain: Column, capped: Column) -> Column:
    """The first that holds."""
    names = ("recognition_failed", "numeric_ocr_pattern_unresolved", "decoder_attention_span_trimmed", "decoder_loop_trimmed", "unsupported_ocr_insertion_removed", "tail_segment_suppressed", "tail_segment_uncertain", "width_cap_unresolved")
    out = F.lit(None).cast("string")
    for holds, name in reversed(list(zip((empty, numeric, span, loop, insertion, suppressed, uncertain, capped), names, strict=True))):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def semantic_decision(text: Column, confidence: Column, error: Column, second: Column, second_confidence: Column, verify: bool = True) -> tuple[Column, Column]:
    """(risk, reason) of a line before its readings are compared; null where the comparison decides."""
    risky = error.isNotNull() | (confidence < 0.62)
    empty = F.trim(text) == ""
    weak = second.isNull() | (second_confidence < 0.90) | F.lit(not verify)
    why = F.when(F.lit(not verify), F.lit("primary_recognition_risk")).when(second.isNull(), F.lit("secondary_unavailable")).otherwise(F.lit("secondary_low_confidence"))
    return (
        F.when(empty, F.lit("high")).when(weak & risky, F.lit("high")).when(weak, F.lit("none")),
        F.when(empty, F.lit("empty_primary_text")).when(weak & risky, why),
    )


def hallucination_risk(split: Column, edge: Column, reduction: Column, dominant: Column, p: Column, ink: Column, blank: Column, density: Column) -> Column:
    add = lambda holds, x: F.when(holds, x).otherwise(F.lit(0.0))
    lit = F.lit
    total = add(split, lit(0.25)) + add(edge, lit(0.08)) + F.least(lit(0.25), 0.8 * reduction) + add(dominant, lit(0.20)) + add(p < 0.78, F.least(lit(0.25), 0.78 - p)) + add(ink < 0.018, lit(0.12)) + add(blank >= 0.10, F.least(lit(0.22), 0.5 * blank)) + add(density > 0.20, lit(0.18))
    return F.least(lit(1.0), total)


def compared_decision(c: Column, risky: Column, trim: bool = True) -> tuple[Column, Column]:
    """(risk, reason) of a line from the comparison of its readings (`readings.comparison`), in that order of rules."""
    extra = c["n_primary"] - c["n_secondary"]
    anchored = (extra > 0) & (c["positions"] >= 0.72) & (c["tail"] >= 0.75)
    removable = anchored & (c["n_secondary"] >= 6) & (extra >= 3) & risky & F.lit(trim)
    rules = [
        (c["numeric_clash"], "secondary_numeric_disagreement"), (c["numeric_suffix"], "numeric_suffix_protected"), (removable, "unsupported_suffix_removed"),
        (anchored, "secondary_suffix_disagreement"), (extra < 0, "secondary_indicates_primary_omission"), (c["material"] < 0.72, "secondary_material_disagreement"), (risky, "primary_recognition_risk"),
    ]
    reason = F.coalesce(*[F.when(holds, F.lit(name)) for holds, name in rules])
    return F.when(reason == "unsupported_suffix_removed", F.lit("medium")).when(reason.isNotNull(), F.lit("high")).otherwise(F.lit("none")), reason


def verified(disagreement: Column, confidence: Column, matched: Column, least: float = 0.80) -> Column:
    """Reason of a collected verifier: no line, an unsure line, or how a sure one disagrees."""
    return F.when(~matched, F.lit("tesseract_line_unmatched")).when(confidence < least, F.lit("tesseract_low_confidence")).otherwise(disagreement)


def retry_priority(reasons: Column, error: Column, confidence: Column) -> Column:
    """Points by which lines of a page are tried again."""
    has = lambda r, points: F.when(F.array_contains(reasons, r), F.lit(points)).otherwise(F.lit(0.0))
    failed = F.when(error == "decoder_loop_trimmed", F.lit(260.0)).when(error.isNotNull(), F.lit(100.0)).otherwise(F.lit(0.0))
    named = has("tesseract_numeric_disagreement", 300.0) + has("secondary_indicates_primary_omission", 220.0) + has("tesseract_material_disagreement", 180.0) + has("secondary_material_disagreement", 160.0)
    return named + failed + F.greatest(F.lit(0.0), 1.0 - confidence) * 10.0


def candidate_score(split: Column, tail: Column, p: Column, loop: Column, near_loop: Column, blank: Column, density: Column, sure: float = 0.72) -> Column:
    """How much a segment's reading deserves a look at the decoder's evidence; 0.38 or more selects it."""
    add = lambda holds, x: F.when(holds, x).otherwise(F.lit(0.0))
    lit = F.lit
    parts = [add(split, lit(0.22)), add(tail, lit(0.12)), add(p < sure, F.least(lit(0.28), sure - p + 0.08)), add(loop, lit(0.42)), add(near_loop, lit(0.40)), add(blank >= 0.12, lit(0.10)), add(density > 0.20, lit(0.18))]
    return F.least(lit(1.0), sum(parts[1:], parts[0]))


def needs_verification(error: Column, confidence: Column, risk: Column, text: Column, verifier: Column) -> Column:
    """Whether a line is worth a second recogniser: errors, doubt, risk, digits, or punctuation the verifier reads else."""
    differs = verifier.isNotNull() & (T.punctuation_signature(text) != T.punctuation_signature(verifier))
    return error.isNotNull() | (confidence < 0.62) | (risk != "none") | text.rlike(r"\p{Nd}") | F.coalesce(differs, F.lit(False))


def tail_decision(blank: Column, p: Column, ink: Column, text: Column) -> Column:
    """suppressed, uncertain or null: what becomes of the last segment of a line; digits are never suppressed."""
    suspicious = (blank >= 0.18) | ((p < 0.58) & (ink < 0.012))
    none = (ink <= 0) | ((ink < 0.012) & (p < 0.45) & (F.length(text) >= 6))
    return F.when(suspicious & none & ~text.rlike(r"\p{Nd}"), F.lit("tail_segment_suppressed")).when(suspicious, F.lit("tail_segment_uncertain"))


def deferred_risk(risk: Column, error: Column, confidence: Column) -> tuple[Column, Column]:
    late = (risk == "none") & (error.isNotNull() | (confidence < 0.62))
    return F.when(late, F.lit("high")).otherwise(risk), F.when(late, F.lit("primary_recognition_risk"))


def heading_labels(given: str) -> list[str]:
    """Labels of a comma-separated setting; chương where it names none."""
    return [x.strip().casefold() for x in given.split(",") if x.strip()] or ["chương"]


def heading(text: Column, labels: list[str]) -> Column:
    """incomplete for a bare label, complete for one with its number, else null."""
    any_of = "|".join(f"\\Q{x}\\E" for x in labels)
    bare = F.lower(F.rtrim(T.strip(text), F.lit(".:;- ")))
    full = F.lower(T.normalized(text)).rlike(rf"^(?:{any_of})\s+(?:[ivxlcdm]{{1,8}}|\d{{1,4}})$")
    return F.when(bare.isin(labels), F.lit("incomplete")).when(full, F.lit("complete"))


def heading_accepted(retried: Column, error: Column, confidence: Column, before: Column, labels: list[str]) -> Column:
    return error.isNull() & (F.coalesce(heading(retried, labels), F.lit("")) == "complete") & (confidence >= F.greatest(F.lit(0.45), before - 0.25))


def beam_accepted(retried: Column, original: Column, looped: Column) -> Column:
    """Whether a beam's reading stands in for a looping one: some text, no loop, not much shorter."""
    return (T.strip(retried) != "") & ~looped & (F.length(retried) >= F.ceil(0.45 * F.length(original)))


def retained(reasons: Column, revalidatable: list[str]) -> Column:
    """Reasons that a new reading cannot lift."""
    return F.array_except(reasons, F.array(*[F.lit(r) for r in revalidatable]))
