"""Measures of grey images, given as 8-bit samples row by row and a width; numpy in Arrow batches.

Defined cases: null or empty samples, or a width that does not divide them, have no ink (0.0) and the reason
empty_image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

INK, DARK = 210, 190


def grid(data: bytes | None, width: int) -> np.ndarray:
    flat = np.frombuffer(data or b"", np.uint8)
    return flat.reshape(-1, width) if width and width > 0 and len(flat) % width == 0 else flat[:0].reshape(0, 1)


def dark_ratio(g: np.ndarray) -> float:
    """Share of dark samples within a border of 3 %."""
    y, x = int(g.shape[0] * 0.03), int(g.shape[1] * 0.03)
    inner = g[y : g.shape[0] - y, x : g.shape[1] - x]
    return float((inner < DARK).mean()) if inner.size else 0.0


def rotated(g: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """The image turned counter-clockwise about its centre, bilinear, within its frame."""
    if not degrees or not g.size:
        return g
    h, w = g.shape
    a, (y, x) = np.deg2rad(degrees), np.mgrid[:h, :w].astype(float)
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sy, sx = dy * np.cos(a) + dx * np.sin(a) + (h - 1) / 2, dx * np.cos(a) - dy * np.sin(a) + (w - 1) / 2
    padded = np.pad(g.astype(float), 1, constant_values=fill)
    sy, sx = np.clip(sy + 1, 0, h + 0.999), np.clip(sx + 1, 0, w + 0.999)
    i, j = sy.astype(int), sx.astype(int)
    v, u = sy - i, sx - j
    out = padded[i, j] * (1 - v) * (1 - u) + padded[i + 1, j] * v * (1 - u) + padded[i, j + 1] * (1 - v) * u + padded[i + 1, j + 1] * v * u
    return np.rint(out).astype(np.uint8)


def skew(g: np.ndarray, widest: int = 600, most: float = 3.0, step: float = 0.25) -> float:
    """The angle by which lines lean: the turn, first of equals, that makes ink by rows most uneven, reversed."""
    if not g.size:
        return 0.0
    if g.shape[1] > widest:
        rows = np.linspace(0, g.shape[0] - 1, max(1, round(g.shape[0] * widest / g.shape[1]))).round().astype(int)
        g = g[rows][:, np.linspace(0, g.shape[1] - 1, widest).round().astype(int)]
    angles = np.arange(-most, most + step / 2, step)
    return -float(angles[np.argmax([np.var((rotated(g, a) < DARK).sum(axis=1)) for a in angles])]) + 0.0


def upright(g: np.ndarray, action: str, rotation: int, lean: float) -> np.ndarray:
    """The image as the quality gate wants it: turned back by quarter turns, or by its lean."""
    if action == "rotate_metadata":
        return np.rot90(g, -(rotation // 90))
    return rotated(g, -lean) if action == "deskew_required" else g


def components(ink: np.ndarray) -> list[tuple[int, int, int]]:
    """(area, height, width) of regions joined by sides or corners: runs of a row are united with touching runs above."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(ink):
        edges = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0])).reshape(-1, 2)
        here = []
        for a, b in edges.tolist():
            me = len(parent)
            parent.append(me)
            boxes.append([b - a, y, y, a, b])
            for c, d, other in above:
                if c <= b and a <= d:
                    parent[root(other)] = root(me)
            here.append((a, b, me))
        above = here
    found: dict[int, list[int]] = {}
    for i, (n, y0, y1, a, b) in enumerate(boxes):
        f = found.setdefault(root(i), [0, y0, y1, a, b])
        f[:] = f[0] + n, min(f[1], y0), max(f[2], y1), min(f[3], a), max(f[4], b)
    return [(n, y1 - y0 + 1, b - a) for n, y0, y1, a, b in found.values()]


def nontext_reason(g: np.ndarray, least_ink: float = 0.0015) -> str | None:
    """Why a crop holds no text: empty, nearly blank, or a rule, wide and thin."""
    if not g.size:
        return "empty_image"
    ink = g < INK
    h, w = ink.shape
    if ink.mean() <= least_ink:
        return "near_blank"
    if w / h < 4.0:
        return None
    active = np.mean(ink.mean(axis=1) >= max(2.0 / w, 0.01))
    parts = [c for c in components(ink) if c[0] >= 2]
    tall, wide = (max((c[k] for c in parts), default=0) for k in (1, 2))
    band = ink.mean() <= 0.08 and active <= 0.15 and ink.any(axis=0).mean() >= 0.20 and tall <= 0.20 * h
    return "horizontal_rule_or_dotted_leader" if band and wide >= 0.80 * w else None


def ink_stats(g: np.ndarray) -> tuple[float, float]:
    """Shares of ink among samples, and of columns that hold ink."""
    ink = g < INK
    return (float(ink.mean()), float(ink.any(axis=0).mean())) if g.size else (0.0, 0.0)


def edge_blanks(g: np.ndarray) -> tuple[float, float]:
    """Shares of the width that are blank before the first and after the last column of ink; 1, 1 without ink."""
    at = np.flatnonzero((g < INK).any(axis=0)) if g.size else []
    return (float(at[0] / g.shape[1]), float((g.shape[1] - 1 - at[-1]) / g.shape[1])) if len(at) else (1.0, 1.0)


MEASURES = T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("dark", "skew", "ink", "ink_columns", "lead", "trail")), T.StructField("nontext", T.StringType())])


@F.pandas_udf(MEASURES)
def features(data: pd.Series, width: pd.Series) -> pd.DataFrame:
    """All measures of an image in one pass."""
    grids = [grid(d, int(w) if pd.notna(w) else 0) for d, w in zip(data, width, strict=True)]
    rows = [(dark_ratio(g), skew(g), *ink_stats(g), *edge_blanks(g), nontext_reason(g)) for g in grids]
    return pd.DataFrame(rows, columns=["dark", "skew", "ink", "ink_columns", "lead", "trail", "nontext"])


@F.pandas_udf(T.BinaryType())
def corrected(data: pd.Series, width: pd.Series, action: pd.Series, rotation: pd.Series, lean: pd.Series) -> pd.Series:
    return pd.Series([upright(grid(d, int(w)), a, int(r), float(s)).tobytes() for d, w, a, r, s in zip(data, width, action, rotation, lean, strict=True)])
