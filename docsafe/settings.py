"""Settings that a user may change, with their bounds: from the session, the environment, or a file of NAME=value lines.

`read` looks for spark.docsafe.<name> in a session, then DOCSAFE_<NAME> in the environment, then in the file, and takes the
default otherwise; other names are ignored. A value that does not parse or is out of its bounds raises.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from docsafe.functions.readings import Floors

#: name, default, least, most. Fixed values.
FIELDS = """
recognition_window_pages 3 1 8
recognition_pixel_budget 12288 512 65536
recognition_batch_size 32 1 32
recognition_batch_width_ratio 2.0 1.0 4.0
seam_max_token_overlap 4 1 12
seam_max_char_overlap 32 4 128
tail_segment_max_retries_per_page 2 0 16
hallucination_guard_max_rechecks_per_page 4 0 32
hallucination_guard_risk_threshold 0.48 0.0 1.0
hallucination_guard_suffix_only true - -
hallucination_guard_confidence_tolerance 0.04 0.0 0.5
hallucination_guard_edge_blank_ratio 0.10 0.0 0.95
hallucination_guard_numeric_min_crop_change_ratio 0.16 0.0 0.95
hallucination_guard_max_removed_token_ratio 0.35 0.01 0.8
hallucination_guard_min_anchor_tokens 1 1 8
decoder_evidence_max_checks_per_page 8 0 10000
decoder_evidence_full_coverage false - -
semantic_retry_min_verifier_confidence 0.88 0.0 1.0
semantic_retry_min_diacritic_verifier_confidence 0.94 0.0 1.0
semantic_retry_min_secondary_confidence 0.90 0.0 1.0
semantic_retry_min_variant_confidence 0.78 0.0 1.0
semantic_retry_min_verifier_similarity 0.88 0.0 1.0
semantic_retry_min_secondary_similarity 0.72 0.0 1.0
semantic_retry_min_material_gain 0.015 0.0 0.5
semantic_retry_max_lines_per_page 32 0 32
partial_remediation_max_lines_per_page 8 0 32
chapter_heading_max_retries_per_page 2 0 8
max_beam_retries_per_page 1 0 16
max_pdf_bytes 2147483648 1024 -
max_pages 5000 1 -
web_upload_max_bytes 104857600 1024 -
"""
TRUE, FALSE = ("1", "true", "yes", "on", "t", "y"), ("0", "false", "no", "off", "f", "n")


def _number(text: str) -> int | float:
    return float(text) if "." in text else int(text)


def _value(name: str, given: str, default: Any, low: str, high: str) -> Any:
    text = given.strip()
    try:
        if isinstance(default, bool):
            if text.lower() not in TRUE + FALSE:
                raise ValueError(text)
            return text.lower() in TRUE
        value = int(text) if isinstance(default, int) else float(text)
    except ValueError as e:
        raise ValueError(f"{name}: {given!r} is no {type(default).__name__}") from e
    if (low != "-" and not value >= _number(low)) or (high != "-" and not value <= _number(high)):
        raise ValueError(f"{name}: {given!r} is not within {low} and {high}")
    return value


def from_file(path: str | Path) -> dict[str, str]:
    """NAME=value lines of a file, quotes taken off; comments and other lines are left out, a missing file has none."""
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    except FileNotFoundError:
        return {}
    found = (re.fullmatch(r"\s*(?:export\s+)?(\w+)\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|(.*?))\s*(?:\s#.*)?", x) for x in lines)
    return {m[1].upper(): next(v for v in m.groups()[1:] if v is not None) for m in found if m}


def read(spark: SparkSession | None = None, env: Mapping[str, str] = os.environ, path: str | Path = ".env") -> dict[str, Any]:
    """Every setting by its name."""
    given = from_file(path) | {k.upper(): v for k, v in env.items()}
    out = {}
    for name, default, low, high in (x.split() for x in FIELDS.strip().splitlines()):
        plain = default == "true" if default in ("true", "false") else _number(default)
        text = spark.conf.get(f"spark.docsafe.{name}", None) if spark else None
        text = given.get(f"DOCSAFE_{name.upper()}") if text is None else text
        out[name] = plain if text is None else _value(name, text, plain, low, high)
    return out


def floors(settings: Mapping[str, Any]) -> Floors:
    """The evidence that decisions over several readings ask for, for `readings` and `operators.semantic`."""
    retry, guard = (lambda k: settings[f"semantic_retry_min_{k}"]), (lambda k: settings[f"hallucination_guard_{k}"])
    return Floors(
        verifier=retry("verifier_confidence"), verifier_marks=retry("diacritic_verifier_confidence"), secondary=retry("secondary_confidence"), variant=retry("variant_confidence"),
        verifier_likeness=retry("verifier_similarity"), secondary_likeness=retry("secondary_similarity"), gain=retry("material_gain"),
        removed=guard("max_removed_token_ratio"), tolerance=guard("confidence_tolerance"), edge_blank=guard("edge_blank_ratio"), anchor=guard("min_anchor_tokens"),
    )
