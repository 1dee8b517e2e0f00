"""HTML extraction by a recurrent block labeller.

A page is cut into blocks: stretches of text between block-level tags. Each block is read as two hashed bags, the tags
and attribute words on its path and the words of its text, and a few counts. A bidirectional LSTM in numpy runs over
all blocks of a page, so every block is judged with the whole document on both sides, and labels it main text or not.
The weights are trained by train_html.py on pages of its own making and lie in models/html_blocks.npz.

Defined cases: a null, empty or textless html gives an empty text and 0 characters; a page cut off inside a tag loses
that tag only; elements that are never closed end with their parent; very long pages are read whole; repeated rows are
extracted each; nulls in page_id or url are kept; other columns are ignored. Scripts, styles, closed templates, comments
and the head are never blocks; a script, style or title that is never closed takes the rest of the page. A quote opens
a value only after an equals sign. Character references are decoded, white space in a block becomes one space.
"""

from __future__ import annotations

import html as entities
import io
import pkgutil
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docsafe.llm import _shared
from docsafe.llm._words import words

PATHS, WORDS, COUNTS, HIDDEN = 512, 128, 6, 16
MODEL = Path(__file__).parent / "models" / "html_blocks.npz"

BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template head title".split())
#: Ordinary elements whose text stands apart from the words around them.
APART = frozenset("noscript svg iframe object canvas audio video".split())
#: A new element of the first kind ends an open one of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(>|\Z)|<(?=[a-zA-Z/])[^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=1 << 14)
def _named(tag: str, attributes: str) -> tuple[str, ...]:
    found = [w.lower() for m in NAMES.finditer(attributes) for w in SPLIT.split(m[1] or m[2] or m[3] or "") if w]
    return (tag, *dict.fromkeys(f".{w}" for w in found))


@lru_cache(maxsize=1 << 14)
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)


def blocks(page: str | None) -> list[tuple[str, tuple[tuple[str, ...], ...], int, int]]:
    """(text, path, characters in links, tags inside) of each block in page order."""
    out, stack, parts = [], [], []
    linked = inside = depth = at = 0
    page = page or ""

    def close() -> None:
        nonlocal linked, inside
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((text, tuple(x[1] for x in stack), min(linked, len(text)), inside))
        parts.clear()
        linked = inside = 0

    while at < len(page):
        m = TAG.search(page, at)
        cut = m.start() if m else len(page)
        if cut > at:
            parts.append(page[at:cut])
            if depth:
                linked += cut - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                depth = max(0, depth - 1)
            elif tag in APART:
                parts.append(" ")
            elif tag in BLOCKS:
                close()
                depth = 0
                if any(x[0] == tag for x in stack):
                    while stack.pop()[0] != tag:
                        pass
            continue
        if tag in RAW:
            if not (m[3] or "").endswith("/") or tag in ("script", "style"):
                # a head that is never closed ends where the body begins
                end = _ends(tag).search(page, at)
                if tag == "head":
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    at = body.start() if body and not (end and end.end() <= body.start()) else end.end() if end else at
                else:
                    at = end.end() if end else at if tag == "template" else len(page)
            parts.append(" ")
        elif tag in BLOCKS:
            close()
            depth = 0
            for other in CLOSES.get(tag, ()):
                if stack and stack[-1][0] == other:
                    stack.pop()
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag not in VOID:
                stack.append((tag, _named(tag, m[3] or "")))
        elif tag == "a":
            depth += 1
            inside += 1
        elif tag in VOID:
            parts.append(" ")
        else:
            inside += 1
            if tag in APART:
                parts.append(" ")
    close()
    return out


def _bucket(token: str, n: int) -> int:
    return zlib.crc32(token.encode()) % n


@lru_cache(maxsize=1 << 15)
def path_buckets(path: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
    """Buckets of all tags and attribute words on the path, and of the nearest two once more by their place."""
    found = {_bucket(t, PATHS) for x in path for t in x}
    for k, x in enumerate(reversed(path[-2:])):
        found |= {_bucket(f"{k}<{t}", PATHS) for t in x}
    return tuple(sorted(found))


def counts(rows: list[tuple[str, tuple, int, int]]) -> np.ndarray:
    """Length, words, share in links, tags, stops, place on the page."""
    n = len(rows)
    out = np.zeros((n, COUNTS), np.float32)
    for i, (text, _, linked, inside) in enumerate(rows):
        out[i] = (min(np.log1p(len(text)), 8) / 8, min(np.log1p(text.count(" ") + 1), 6) / 6, linked / len(text), min(inside, 10) / 10, min(sum(text.count(c) for c in ".!?"), 10) / 10, i / n)
    return out


def word_bags(texts: list[str]) -> np.ndarray:
    """Share of each word bucket in each text, the root taken."""
    w = words(pa.array(texts, pa.large_string()))
    bag = np.bincount(w.owner() * WORDS + (w.hashes(fold=True) % np.uint64(WORDS)).astype(np.int64), minlength=len(texts) * WORDS).reshape(len(texts), WORDS)
    return np.sqrt(bag / np.maximum(bag.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(inputs: np.ndarray, mask: np.ndarray, recur: np.ndarray) -> np.ndarray:
    """Hidden states over projected inputs (pages, blocks, 4 * HIDDEN): gates in, forget, out, and the candidate."""
    pages, steps, _ = inputs.shape
    h, c = np.zeros((2, pages, HIDDEN), np.float32)
    out = np.zeros((pages, steps, HIDDEN), np.float32)
    for t in range(steps):
        z = inputs[:, t] + h @ recur
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        new = f * c + i * np.tanh(z[:, 3 * HIDDEN :])
        live = mask[:, t, None]
        c = np.where(live, new, c)
        h = np.where(live, o * np.tanh(new), h)
        out[:, t] = h
    return out


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}
        self.paths: dict[tuple, np.ndarray] = {}

    @classmethod
    @lru_cache(maxsize=1)
    def trained(cls) -> Labeller:
        with np.load(io.BytesIO(pkgutil.get_data(__package__, f"models/{MODEL.name}"))) as f:
            return cls(dict(f))

    def project(self, rows: list[tuple[str, tuple, int, int]], places: np.ndarray) -> np.ndarray:
        """(blocks, 2 * 4 * HIDDEN): what each direction's gates take from the block itself."""
        w = self.w
        out = word_bags([r[0] for r in rows]) @ w["words"] + places @ w["counts"] + w["bias"]
        if len(self.paths) > 1 << 15:
            self.paths.clear()
        for i, r in enumerate(rows):
            if (p := self.paths.get(r[1])) is None:
                p = self.paths[r[1]] = w["paths"][list(path_buckets(r[1]))].sum(axis=0) if r[1] else np.zeros(8 * HIDDEN, np.float32)
            out[i] += p
        return out

    def scores(self, pages: list[list[tuple[str, tuple, int, int]]]) -> list[np.ndarray]:
        """The chance that each block is main text; pages are run together, alike in length."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to, most = at, 0
            while to < len(order) and (to == at or (len(pages[order[to]]) * (to - at + 1) <= 1 << 14 and len(pages[order[to]]) <= 2 * most + 8)):
                most = most or len(pages[order[to]])
                to += 1
            part = [pages[i] for i in order[at:to]]
            sizes = np.array([len(p) for p in part])
            x = self.project([r for p in part for r in p], np.concatenate([counts(p) for p in part]))
            steps = sizes.max()
            mask = np.arange(steps)[None, :] < sizes[:, None]
            wide = np.zeros((len(part), steps, 8 * HIDDEN), np.float32)
            wide[mask] = x
            back = np.where(mask, sizes[:, None] - 1 - np.arange(steps)[None, :], np.arange(steps)[None, :])
            lines = np.arange(len(part))[:, None]
            f = lstm(wide[:, :, : 4 * HIDDEN], mask, self.w["recur_f"])
            b = lstm(wide[lines, back][:, :, 4 * HIDDEN :], mask, self.w["recur_b"])[lines, back]
            p = sigmoid(f @ self.w["out_f"] + b @ self.w["out_b"] + self.w["out"])
            for k, i in enumerate(order[at:to]):
                out[i] = p[k, : sizes[k]]
            at = to
        return out


def main_text(pages: list[str | None], labeller: Labeller | None = None) -> list[str]:
    labeller = labeller or Labeller.trained()
    cut = [blocks(p) for p in pages]
    return ["\n".join(r[0] for r, s in zip(rows, found, strict=True) if s > 0.5) for rows, found in zip(cut, labeller.scores(cut), strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _shared.slices(batch.column("html"), 2 << 20):
                part = batch.slice(a, b - a)
                texts = main_text(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return _shared.mapped(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
