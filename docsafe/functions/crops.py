"""Crops of lines from grey pages: straightened quadrilaterals, boxes for another look, and wide lines cut at blanks.

Images are 8-bit samples row by row and a width, as in `images`; for places of cuts alone, the ink of their columns is
enough (`many_segments`). Defined cases: an empty or null image gives an empty crop
and no segments; a polygon of fewer than three distinct points is boxed by its axes.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsafe.functions import images

WHITE = 255


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    points = np.unique(points, axis=0)
    sides = []
    for way in (points, points[::-1]):
        side: list[np.ndarray] = []
        for p in way:
            while len(side) > 1 and np.linalg.det(np.array([side[-1] - side[-2], p - side[-2]])) <= 0:
                side.pop()
            side.append(p)
        sides += side[:-1]
    return np.array(sides)


def least_box(points: np.ndarray) -> np.ndarray:
    """Corners of the smallest rectangle, at any angle, around points; one of its sides lies on a side of their hull."""
    corners = hull(points)
    if len(corners) < 3:
        (x0, y0), (x1, y1) = points.min(axis=0), points.max(axis=0)
        return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    edges = np.roll(corners, -1, axis=0) - corners
    along = edges / np.linalg.norm(edges, axis=1, keepdims=True)
    across = np.stack([-along[:, 1], along[:, 0]], axis=1)
    u, v = corners @ along.T, corners @ across.T
    best = int(np.argmin(np.ptp(u, axis=0) * np.ptp(v, axis=0)))
    us, vs = (u[:, best].min(), u[:, best].max()), (v[:, best].min(), v[:, best].max())
    return np.array([us[i] * along[best] + vs[j] * across[best] for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])


def corners(points: np.ndarray) -> np.ndarray:
    """Four corners from the top left clockwise: least and greatest sums and differences of their places."""
    box = points if len(points) == 4 else least_box(points)
    total, slope = box.sum(axis=1), box[:, 1] - box[:, 0]
    return box[[total.argmin(), slope.argmin(), total.argmax(), slope.argmax()]]


def projection(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four target points to their source points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(target, source, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)[0], 1.0).reshape(3, 3)


def sampled(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples at places of an image; white outside."""
    h, w = g.shape
    framed = np.pad(g.astype(float), 1, constant_values=WHITE)
    x, y = np.clip(x + 1, 0, w + 0.9999), np.clip(y + 1, 0, h + 0.9999)
    i, j = y.astype(int), x.astype(int)
    b, a = y - i, x - j
    top, low = framed[i, j] * (1 - a) + framed[i, j + 1] * a, framed[i + 1, j] * (1 - a) + framed[i + 1, j + 1] * a
    return np.rint(top * (1 - b) + low * b).astype(np.uint8)


def straightened(g: np.ndarray, points: np.ndarray, padding: float = 0.04) -> np.ndarray:
    """The quadrilateral of a line as an upright image, with a margin of a share of its sides, one sample at least."""
    if not g.size or not len(points):
        return g[:0]
    a, b, c, d = quad = corners(np.asarray(points, float))
    side = lambda p, q: int(np.linalg.norm(p - q))
    w, h = max(side(c, d), side(b, a), 1), max(side(b, c), side(a, d), 1)
    mx, my = max(1, round(w * padding)), max(1, round(h * padding))
    target = np.array([(mx, my), (mx + w - 1, my), (mx + w - 1, my + h - 1), (mx, my + h - 1)], float)
    m = projection(target, quad)
    y, x = np.mgrid[: h + 2 * my, : w + 2 * mx]
    u, v, z = np.tensordot(m, np.stack([x, y, np.ones_like(x)]).astype(float), 1)
    z = np.where(np.abs(z) < 1e-12, 1e-12, z)
    return sampled(g, u / z, v / z)


def again_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, padding: float = 0.12, right: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """The box of a second look within a page: a margin of a share of the line's height, and as much more to the right as
    `right` of it, for headings that may go on there."""
    tall = F.greatest(F.lit(1.0), y1 - y0)
    margin = lambda share: F.greatest(F.lit(1), F.bround(tall * share)).cast("long")
    pad, more = margin(padding), margin(right) if right else F.lit(0)
    return F.greatest(F.lit(0), F.floor(x0) - pad), F.greatest(F.lit(0), F.floor(y0) - pad), F.least(width, F.ceil(x1) + pad + more), F.least(height, F.ceil(y1) + pad)


class Segment(NamedTuple):
    core_left: int
    core_right: int
    source_left: int
    source_right: int
    ink: float
    ink_columns: float
    is_tail: bool
    width: int
    samples: bytes


def resized(width: int, height: int, target: int) -> int:
    return max(10, math.ceil(target * width / max(height, 1) / 10) * 10)


def valleys(g: np.ndarray, margin: int, most_ink: float) -> np.ndarray:
    """(centre, width, ink at the centre) of blank stretches of two columns and more that lie off both ends."""
    ink, window = (g < images.INK).mean(axis=0), max(1, g.shape[0] // 8)
    smooth = np.convolve(ink, np.full(window, 1 / window), "same") if window > 1 else ink
    edge = np.flatnonzero(np.diff(np.concatenate([[0], smooth <= most_ink, [0]])))
    start, end = edge[::2], edge[1::2]
    centre = (start + end) // 2
    fit = (end - start >= 2) & (centre >= margin) & (centre <= g.shape[1] - margin)
    return np.stack([centre[fit], (end - start)[fit], smooth[np.minimum(centre[fit], g.shape[1] - 1)]], axis=1)


def places(found: np.ndarray, width: int, wanted: int, cap: int, margin: int, most: int) -> list[int] | None:
    """Where a line is cut, its ends included: each time the valley nearest to a segment of the wanted width, of equals the
    widest, then the one of least ink. None where a stretch has no valley within its cap."""
    out = [0]
    while width - out[-1] > cap and len(out) < most:
        low, high = out[-1] + margin, min(width - margin, out[-1] + cap)
        near = found[(found[:, 0] >= low) & (found[:, 0] <= high) & (found[:, 0] > out[-1])]
        if not len(near):
            return None
        best = np.lexsort((near[:, 2], -near[:, 1], np.abs(near[:, 0] - out[-1] - wanted)))[0]
        out.append(int(near[best, 0]))
    return [*out, width]


class Room(NamedTuple):
    """Widths of segments of lines of a height, on the line: the one wanted, the most with and without overlap, the least."""

    wanted: int
    full: int
    cap: int
    margin: int
    lap: int


def _room(h: int, height: int, widest: int, target: float, overlap: float) -> Room:
    lap = max(0, round(h * overlap))
    wanted = max(24, math.floor(max(64, min(widest, int(widest * target))) * h / max(height, 1)))
    full = max(wanted, math.floor((widest - 10) * h / max(height, 1)) - 4)
    cap = max(24, full - 2 * lap)
    wanted = min(wanted, cap)
    return Room(wanted, full, cap, max(20, int(wanted * 0.24)), lap)


def segments(g: np.ndarray, height: int = 32, widest: int = 512, target: float = 0.92, most: int = 6, most_ink: float = 0.02, overlap: float = 0.0) -> list[Segment]:
    """A line as segments that a recogniser of a bounded width takes, each with two white columns at both sides and with
    some of its neighbours where `overlap`, a share of the height, asks for it. The whole line is the only segment where it
    fits, or where it cannot be cut so that all do."""
    if not g.size:
        return []
    h, w = g.shape
    whole = [Segment(0, w, 0, w, *images.ink_stats(g), True, w, g.tobytes())]
    if resized(w, h, height) <= widest:
        return whole
    wanted, full, cap, margin, lap = _room(h, height, widest, target, overlap)
    cuts = places(valleys(g, margin, most_ink), w, wanted, cap, margin, most)
    if not cuts or len(cuts) < 3 or min(np.diff(cuts)) < margin:
        return whole
    out = []
    for left, right in zip(cuts, cuts[1:], strict=False):
        a, b = min(lap, left), min(lap, w - right)
        while right + b - left + a > full and (a or b):  # less of the larger side, of the right one first
            a, b = (a, b - 1) if b >= a else (a - 1, b)
        part = np.pad(g[:, left - a : right + b], ((0, 0), (2, 2)), constant_values=WHITE)
        if resized(part.shape[1], h, height) > widest:
            return whole
        out.append(Segment(left, right, left - a, right + b, *images.ink_stats(part), right == w, part.shape[1], part.tobytes()))
    return out


def ink_runs(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An image as runs of columns with equally many samples of ink: these, and the columns of each run."""
    ink = (g < images.INK).sum(axis=0)
    at = np.flatnonzero(np.diff(ink, prepend=-1))
    return ink[at], np.diff(at, append=len(ink))


class Cuts(NamedTuple):
    """Segments of many lines: the line of each, its number there, and what `Segment` has, an array each."""

    line: np.ndarray
    segment: np.ndarray
    core_left: np.ndarray
    core_right: np.ndarray
    source_left: np.ndarray
    source_right: np.ndarray
    ink: np.ndarray
    ink_columns: np.ndarray
    is_tail: np.ndarray
    width: np.ndarray


def _valleys(ink: np.ndarray, columns: np.ndarray, of: np.ndarray, wide: np.ndarray, width: np.ndarray, h: int, margin: int, most_ink: float) -> tuple[np.ndarray, ...]:
    """`valleys` of the wide ones of many lines given as runs: line, centre, width, ink at the centre. Of a long run the
    ends and one column are looked at, since the others have the same neighbours as that."""
    window = max(1, h // 8)
    runs = np.flatnonzero(wide[of])
    # blank columns after each line, that are no valley, keep the lines apart
    line = np.concatenate([of[runs], np.flatnonzero(wide)])
    order = np.argsort(line, kind="stable")
    apart = (np.arange(len(line)) >= len(runs))[order]
    line, ink, columns = line[order], np.append(ink[runs], np.zeros(wide.sum(), ink.dtype))[order], np.append(columns[runs], np.full(wide.sum(), window))[order]
    begin = np.cumsum(columns) - columns
    begin -= np.repeat(begin[np.flatnonzero(np.diff(line, prepend=-1))], np.bincount(line, minlength=len(wide))[wide])
    kept = np.minimum(columns, 2 * window + 1)
    run = np.repeat(np.arange(len(kept)), kept)
    place = np.arange(len(run)) - np.repeat(np.cumsum(kept) - kept, kept)
    place = begin[run] + np.where(place > window, columns[run] - kept[run] + place, place)
    smooth = ink[run] / h
    smooth = np.convolve(smooth, np.full(window, 1 / window), "same")[: len(run)] if window > 1 and len(run) else smooth
    edge = np.flatnonzero(np.diff((smooth <= most_ink) & ~apart[run], prepend=False, append=False))
    start, end, line = place[edge[::2]], place[edge[1::2]], line[run]
    own = line[edge[::2]]
    centre = (start + end) // 2
    fit = (end - start >= 2) & (centre >= margin) & (centre <= width[own] - margin)
    far = int(width.max(initial=0)) + window + 1
    at = np.searchsorted(line * far + place, own[fit] * far + np.minimum(centre[fit], width[own[fit]] - 1), "right") - 1
    return own[fit], centre[fit], (end - start)[fit], smooth[at]


def many_segments(ink: np.ndarray, columns: np.ndarray, runs: np.ndarray, h: int, height: int = 32, widest: int = 512, target: float = 0.92, most: int = 6, most_ink: float = 0.02, overlap: float = 0.0) -> Cuts:
    """`segments` of many lines of h rows, without their samples. Lines are given by the runs of `ink_runs`, one line's
    after another's, `runs` of them each; the work is by runs, not by samples."""
    n = len(runs)
    of = np.repeat(np.arange(n), runs)
    ink, columns = np.asarray(ink, np.int64), np.asarray(columns, np.int64)
    ends = np.concatenate([[0], np.cumsum(columns)])
    after = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    base, width = ends[after[:-1]], np.diff(ends[after])
    fits = lambda w: np.maximum(10, np.ceil(height * w / max(h, 1) / 10) * 10) <= widest
    some = (width > 0) & (h > 0)
    cut = some & ~fits(width)
    wanted, full, cap, margin, lap = _room(h, height, widest, target, overlap)
    own, centre, blank, bare = _valleys(ink, columns, of, cut, width, h, margin, most_ink) if cut.any() else (np.zeros(0, np.int64),) * 4
    lefts, parts = np.zeros((n, max(most, 1)), np.int64), np.ones(n, np.int64)
    for k in range(1, most):  # as `places`, a cut of every line at a time
        here = lefts[np.arange(n), parts - 1]
        go = cut & (width - here > cap)
        at = here[own]
        near = np.flatnonzero(go[own] & (centre >= at + margin) & (centre <= np.minimum(width[own] - margin, at + cap)) & (centre > at))
        off = np.abs(centre[near] - at[near] - wanted)
        first = np.flatnonzero(np.diff(own[near], prepend=-1))
        least = np.minimum.reduceat(off, first) if len(first) else off
        near = near[off == np.repeat(least, np.diff(first, append=len(near)))]
        near = near[np.lexsort((bare[near], -blank[near], own[near]))]
        near = near[np.flatnonzero(np.diff(own[near], prepend=-1))]
        cut &= ~go | np.isin(np.arange(n), own[near])
        lefts[own[near], k] = centre[near]
        parts[own[near]] += 1
    cut &= parts > 1
    line = np.repeat(np.arange(n), np.where(cut, parts, 0))
    left = lefts[cut][np.arange(lefts.shape[1]) < parts[cut, None]]
    tail = np.diff(line, append=-1) != 0
    right = np.where(tail, width[line], np.append(left[1:], 0))
    a, b = np.minimum(lap, left), np.minimum(lap, width[line] - right)
    while (much := (right + b - left + a > full) & ((a > 0) | (b > 0))).any():  # less of the larger side, of the right one first
        a, b = a - (much & (a > b)), b - (much & (b >= a))
    samples = right + b - left + a + 4
    cut[line[(right - left < margin) | ~fits(samples)]] = False
    whole, good = np.flatnonzero(some & ~cut), cut[line]
    none = np.zeros(len(whole), np.int64)
    line, left, right, a, b, samples, tail = (np.append(x[good], y) for x, y in ((line, whole), (left, none), (right, width[whole]), (a, none), (b, none), (samples, width[whole]), (tail, none == 0)))
    order = np.argsort(line, kind="stable")
    line, left, right, a, b, samples, tail = (x[order] for x in (line, left, right, a, b, samples, tail))

    def inside(value: np.ndarray) -> np.ndarray:
        """The sum of a value of each column over the segments."""
        total, value = np.concatenate([[0], np.cumsum(value * columns)]), np.append(value, 0)

        def upto(x: np.ndarray) -> np.ndarray:
            run = np.searchsorted(ends, x, "right") - 1
            return total[run] + (x - ends[run]) * value[run]

        return upto(base[line] + right + b) - upto(base[line] + left - a)

    number = np.arange(len(line)) - np.searchsorted(line, line)
    return Cuts(line, number, left, right, left - a, right + b, inside(ink) / (h * samples), inside((ink > 0).astype(np.int64)) / samples, tail.astype(bool), samples)


def widened(g: np.ndarray, resized_width: int, height: int = 32) -> np.ndarray:
    """The image with white at its right, so that it is as wide as wanted once resized."""
    if not g.size or resized(g.shape[1], g.shape[0], height) >= resized_width:
        return g
    more = math.floor(resized_width * g.shape[0] / height) - g.shape[1]
    return np.pad(g, ((0, 0), (0, more)), constant_values=WHITE) if more > 0 else g


CROP = T.StructType([T.StructField("samples", T.BinaryType()), T.StructField("width", T.IntegerType())])
SEGMENT = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("core_left", "core_right", "source_left", "source_right")), T.StructField("ink", T.DoubleType()), T.StructField("ink_columns", T.DoubleType()), T.StructField("is_tail", T.BooleanType()), T.StructField("width", T.IntegerType()), T.StructField("samples", T.BinaryType())])


def _grid(data: bytes | None, width) -> np.ndarray:
    return images.grid(data, int(width) if pd.notna(width) else 0)


def _crop(g: np.ndarray) -> tuple[bytes, int]:
    return g.tobytes(), g.shape[1] if g.size else 0


@F.pandas_udf(CROP)
def line_crop(data: pd.Series, width: pd.Series, points: pd.Series) -> pd.DataFrame:
    """The straightened crop of a polygon, an array of (x, y)."""
    rows = [_crop(straightened(_grid(d, w), np.array([list(x) for x in p] if p is not None else [], float).reshape(-1, 2))) for d, w, p in zip(data, width, points, strict=True)]
    return pd.DataFrame(rows, columns=["samples", "width"])


@F.pandas_udf(CROP)
def box_crop(data: pd.Series, width: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
    """The samples of a box within an image."""
    rows = [_crop(_grid(d, w)[int(b) : int(e), int(a) : int(c)]) for d, w, a, b, c, e in zip(data, width, x0, y0, x1, y1, strict=True)]
    return pd.DataFrame(rows, columns=["samples", "width"])


@F.pandas_udf(T.ArrayType(SEGMENT))
def line_segments(data: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([[s._asdict() for s in segments(_grid(d, w))] for d, w in zip(data, width, strict=True)])
