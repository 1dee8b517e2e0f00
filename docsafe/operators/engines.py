"""Boundaries to detectors and recognisers: models that a user brings, run a batch of images at a time.

A factory is called once in a Python worker and returns the model; it must be picklable. An image that a model fails on
alone has an error code and an empty text; other images of its batch are read again one by one, so none is lost.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Recogniser(Protocol):
    def read(self, images: Sequence[bytes]) -> Sequence[tuple[str, float]]:
        """Text and confidence of each image."""


class Detector(Protocol):
    def detect(self, image: bytes) -> dict:
        """dt_polys and dt_scores of a page."""


def _reader(make: Callable[[], Recogniser]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            images = list(batch["image"])
            try:
                found = [(t, float(c), None) for t, c in model.read(images)]
                if len(found) != len(images):
                    raise ValueError("the model returned another number of texts")
            except Exception:
                found = [_alone(model, x) for x in images]
            yield pd.concat([batch[["image_key"]].reset_index(drop=True), pd.DataFrame(found, columns=["text", "confidence", "error_code"], dtype=object)], axis=1)

    return read


def _alone(model: Recogniser, image: bytes) -> tuple[str, float, str | None]:
    try:
        [(text, confidence)] = model.read([image])
        return text, float(confidence), None
    except Exception as e:
        return "", 0.0, f"recognition_failed:{type(e).__name__}"


def recognise(crops: DataFrame, make: Callable[[], Recogniser]) -> DataFrame:
    """crops (with image) and text, confidence, error_code; equal images are read once. A null image has an empty text
    and the code empty_image."""
    keyed = crops.withColumn("image_key", F.sha2("image", 256))
    once = keyed.where("image is not null").groupBy("image_key").agg(F.any_value("image").alias("image"))
    read = once.mapInPandas(_reader(make), "image_key string, text string, confidence double, error_code string")
    out = keyed.join(read, "image_key", "left").drop("image_key")
    return out.withColumns({"text": F.coalesce("text", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0)), "error_code": F.when(F.col("image").isNull(), F.lit("empty_image")).otherwise(F.col("error_code"))})


def variants(crops: DataFrame, make: Callable[[int], Callable[[], Recogniser]], widths: Sequence[int] = (288, 320, 384)) -> DataFrame:
    """crop_id and variants, an array of (text, confidence, width): each crop as read at each width."""
    parts = [recognise(crops.select("crop_id", "image"), make(w)).where("error_code is null").select("crop_id", F.struct("text", "confidence", F.lit(w).cast("long").alias("width")).alias("v")) for w in widths]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("crop_id").agg(F.array_sort(F.collect_list("v"), lambda a, b: (a["width"] - b["width"]).cast("int")).alias("variants"))


def detect(pages: DataFrame, make: Callable[[], Detector]) -> DataFrame:
    """page_index and payload, as `files.detector_polygons` reads it; a page that fails once is tried once more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            out = []
            for page, image in zip(batch["page_index"], batch["image"], strict=True):
                try:
                    found = model.detect(image)
                except Exception:
                    model = make()
                    found = model.detect(image)
                out.append((page, json.dumps(found)))
            yield pd.DataFrame(out, columns=["page_index", "payload"])

    return pages.select("page_index", "image").where("image is not null").mapInPandas(run, "page_index long, payload string")


class Decoder(Protocol):
    def trace(self, images: Sequence[bytes]) -> Sequence[dict]:
        """Of each image its text and, by character, what `TRACED` names."""


class Extractor(Protocol):
    def pages(self, content: bytes) -> Sequence[str]:
        """The Markdown of each page of a file."""


#: Lists of a decoder's trace: probability, centre and spread of attention, ink support, new ink, new coverage, reuse.
TRACED = ("p", "c", "spread", "s", "novel", "gain", "reuse")


def _traced(found: dict) -> tuple:
    text, lists = found["text"], [[float(x) for x in found.get(k) or []] for k in TRACED]
    if any(len(x) not in (0, len(text)) for x in lists) or not all(lists[i] or not text for i in (0, 1, 3)):
        raise ValueError("the lists of a trace do not fit its text")
    return text, *lists, None


def _trace_alone(model: Decoder, image: bytes | None) -> tuple:
    try:
        [found] = model.trace([image])
        return _traced(found)
    except Exception as e:
        return "", *[[] for _ in TRACED], f"{type(e).__name__}:{e}"


def trace(crops: DataFrame, make: Callable[[], Decoder]) -> DataFrame:
    """crop_id, text, the lists of `TRACED`, error: how a decoder came to its text; an image that fails alone, is null, or has
    lists of another length than its text has the error and empty lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            images = list(batch["image"])
            try:
                found = [_traced(x) for x in model.trace(images)]
                if len(found) != len(images):
                    raise ValueError("the model returned another number of traces")
            except Exception:
                found = [_trace_alone(model, x) for x in images]
            yield pd.DataFrame([(i, *f) for i, f in zip(batch["crop_id"], found, strict=True)], columns=["crop_id", "text", *TRACED, "error"], dtype=object)

    lists = ", ".join(f"{k} array<double>" for k in TRACED)
    return crops.select("crop_id", "image").mapInPandas(run, f"crop_id string, text string, {lists}, error string")


def native_pages(files: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """path, page_index, markdown, failure of files (path, content): a row a page. A file that fails has one row without a
    page and the failure, as `decisions.failed_extraction` takes it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out = [(path, i, text or "", None) for i, text in enumerate(model.pages(content))]
                except Exception as e:
                    out = [(path, None, None, f"{type(e).__name__}:{e}")]
                yield pd.DataFrame(out, columns=["path", "page_index", "markdown", "failure"], dtype=object)

    return files.select("path", "content").mapInPandas(run, "path string, page_index int, markdown string, failure string")


def checked_assets(config: str | Path, weights: str | Path, height: int, read: Callable[[Path], dict]) -> dict:
    """The configuration of a model, for a factory to call on its executor: both files must be there, and the height of the
    images that the model was trained on (dataset.image_height) must be the one in use. Weights are named in it, and a user
    loads them without running what they hold."""
    missing = [str(p) for p in (Path(config), Path(weights)) if not p.is_file()]
    if missing:
        raise FileNotFoundError(f"missing model files: {', '.join(missing)}")
    found: dict[str, Any] = read(Path(config))
    trained = int((found.get("dataset") or {}).get("image_height", 0))
    if trained != height:
        raise ValueError(f"the model reads images of height {trained}, not {height}")
    return found | {"weights": str(weights)}


def verify(pages: DataFrame, command: Sequence[str], seconds: float = 60.0) -> DataFrame:
    """page_index, table, error_code: what a command prints for an image on its standard input; failures and time-outs
    have a code, so that lines can fail closed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *_printed(command, i, seconds)) for p, i in zip(batch["page_index"], batch["image"], strict=True)], columns=["page_index", "table", "error_code"], dtype=object).astype({"page_index": "int64"})

    return pages.select("page_index", "image").mapInPandas(run, "page_index long, table string, error_code string")


def _printed(command: Sequence[str], image: bytes | None, seconds: float) -> tuple[str | None, str | None]:
    try:
        done = subprocess.run(list(command), input=image or b"", capture_output=True, timeout=seconds, check=True)
        return done.stdout.decode("utf-8", "replace"), None
    except FileNotFoundError:
        return None, "tesseract_unavailable"
    except (subprocess.SubprocessError, OSError):
        return None, "tesseract_failed"
