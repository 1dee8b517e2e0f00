"""Weak ends of segments, judged with the next segment of the line as an anchor on their right.

A trace has text, and by character p (probability), c (centre of attention, 0 to 1 of the segment's image), s (ink support),
gain (new coverage of the image) and reuse (attention spent before). A placed trace adds image (width read), border, left and
source (where the segment lies), and line (the line's width). Arrays of gain and reuse that are shorter than the text count
as 1 and 0; a trace without gain is not judged.

The longest end of up to `most` words is taken whose every word, and whose mean, has less ground than the words before it
and the first words of the next segment, that goes over ground already read or hardly moves, and that does not lie past the
anchor.
"""

from __future__ import annotations

import functools
import re
import sys
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsafe.functions import readings as R

MEASURES = ("p", "s", "gain", "reuse")


class Limits(NamedTuple):
    anchor: int = 2
    most: int = 12
    prefix: int = 8
    anchor_p: float = 0.58
    anchor_s: float = 0.10
    support: float = 0.68
    coverage: float = 0.58
    coverage_floor: float = 0.20
    probability: float = 0.92
    bare: float = 0.055
    reuse: float = 0.60
    progress: float = 0.045
    backtrack: float = 0.03


#: Least and most of the floors of probability and support.
FLOORS = ((0.56, 0.72), (0.10, 0.18))


def _floors(numbers: dict[str, np.ndarray], n: int, window: int = 6, prefix: int = 8) -> tuple[float, float]:
    stable = slice(0, max(prefix, n - min(window, n)))
    p, s = (min(most, max(least, share * float(np.median(numbers[k][stable])))) for k, share, (least, most) in zip("ps", (0.68, 0.28), FLOORS, strict=True))
    return p, s


class Trace:
    """The words of a trace with the means of their measures, a row each, and the places of its characters on the line."""

    def __init__(self, t: Any):
        numbers = {k: np.asarray([] if t[k] is None else t[k], float) for k in ("p", "c", "s", "gain", "reuse")}
        text = t["text"] or ""
        n = min(len(text), *(len(numbers[k]) for k in "pcs"))
        self.text, self.judged = text[:n], len(numbers["gain"]) > 0
        for k, fill in (("gain", 1.0), ("reuse", 0.0)):
            numbers[k] = numbers[k] if len(numbers[k]) >= n else np.full(n, fill)
        self.numbers = {k: v[:n] for k, v in numbers.items()}
        self.spans = [m.span() for m in re.finditer(r"\w+", self.text)]
        self.means = np.array([[self.numbers[k][a:b].mean() for k in MEASURES] for a, b in self.spans]).reshape(-1, len(MEASURES))

    def places(self, t: Any) -> np.ndarray:
        inside = np.clip(self.numbers["c"] * max(1, t["image"]) - t["border"], 0, max(1, t["source"]))
        return np.clip((t["left"] + inside) / max(1, t["line"]), 0, 1)

    def floors(self) -> tuple[float, float]:
        return _floors(self.numbers, len(self.text))


class Gap(NamedTuple):
    text: str
    removed: str
    start: int
    end: int
    words: int
    numeric: bool
    score: float


def gap(left: Any, right: Any, k: Limits = Limits()) -> Gap | None:
    """What the left trace says at its end without ground, and its text without that; None where all has ground."""
    if left is None or right is None:
        return None
    a, b = Trace(left), Trace(right)
    if not (a.judged and b.judged) or len(a.spans) < 2 or not b.spans:
        return None
    head = b.means[: k.anchor].mean(axis=0)
    p_floor, s_floor = a.floors()
    if head[0] < max(p_floor, k.anchor_p) or head[1] < max(s_floor, k.anchor_s):
        return None
    here = a.places(left)
    beyond = b.places(right)[: b.spans[min(k.anchor, len(b.spans)) - 1][1]].mean()
    for n in range(min(k.most, len(a.spans) - 1), 0, -1):
        first = len(a.spans) - n
        start, end = a.spans[first][0], a.spans[-1][1]
        prefix = R.nfc(" ".join(a.text[:start].split()))
        if start < k.prefix or len(prefix) < k.prefix:
            continue
        words, span = a.means[first:], a.means[first:].mean(axis=0)
        ground = np.maximum(1e-6, np.minimum(a.means[max(0, first - k.anchor) : first].mean(axis=0), head))
        p, s, gain = k.probability * ground[0], k.support * ground[1], max(k.coverage_floor, k.coverage * ground[2])
        weak = (words[:, 1] <= s) & (words[:, 2] <= gain) & ((words[:, 0] <= p) | (words[:, 1] <= k.bare))
        track = here[start:end]
        idle = span[3] >= k.reuse or abs(track[-1] - track[0]) <= k.progress
        if weak.all() and (span[0] <= p or span[1] <= k.bare) and idle and beyond >= track.mean() - k.backtrack:
            removed = a.text[start:end].strip()
            return Gap(prefix, removed, start, end, n, any(map(str.isdigit, removed)), float(ground[1] - span[1] + ground[2] - span[2] + span[3]))
    return None


def rejected(left: Any, right: Any, k: Limits = Limits()) -> list[str]:
    """Why an end of up to three words stays, by the first two words of the next segment."""
    a, b = (Trace(t) if t is not None else None for t in (left, right))
    if a is None or b is None or not (a.judged and b.judged):
        return ["coverage_metrics_unavailable"]
    if len(a.spans) < 2 or not b.spans:
        return ["insufficient_words"]
    tail, head = a.means[-3:].mean(axis=0), b.means[:2].mean(axis=0)
    held = {"tail_coverage_not_lower": tail[2] >= k.coverage * head[2], "tail_support_not_lower": tail[1] >= k.support * head[1], "tail_attention_not_reused": tail[3] < k.reuse}
    return [name for name, holds in held.items() if holds] or ["boundary_not_confident"]


def diagnostics(left: Any, right: Any) -> dict[str, float]:
    """Means of the end of the left trace and the start of the right one, to be logged with a rejection; 0 without words."""
    parts = {"tail": Trace(left).means[-3:] if left is not None else [], "right": Trace(right).means[:2] if right is not None else []}
    names = ("probability", "support", "coverage_gain", "reuse_ratio")
    return {f"{side}_{name}_mean": round(float(m[:, i].mean()), 4) if len(m) else 0.0 for side, m in parts.items() for i, name in enumerate(names)}


def _even(start: np.ndarray, size: np.ndarray):
    """Runs of a flat array by their size: which, and the places of their elements, a row each. Means over such rows add up
    as means over the runs do."""
    order = np.argsort(size, kind="stable")
    for which in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if len(which) and size[which[0]]:
            yield which, start[which, None] + np.arange(size[which[0]])


@functools.cache
def _letters() -> np.ndarray:
    """Of every code point, whether it is in \\w."""
    return np.array([c == 95 or chr(c).isalnum() for c in range(sys.maxunicode + 1)])


def words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of \\w+ start and end."""
    inside = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], edges[1::2]


class Traces:
    """Many traces: their texts, and the measures of all characters one after another, `size` of them a trace. As `Trace`,
    which is one; `at` has where a trace begins, `first` the number of its first word. Words are measured when asked for."""

    def __init__(self, texts: list[str], numbers: dict[str, np.ndarray], size: np.ndarray, judged: np.ndarray):
        self.texts, self.numbers, self.judged = texts, numbers, judged
        self.at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        start, end = words("\n".join(texts))  # a line break is in no word
        of = np.searchsorted(self.at[:-1] + np.arange(len(texts)), start, "right") - 1
        self.start, self.end = start - of, end - of
        self.first = np.searchsorted(of, np.arange(len(texts) + 1))
        self._means, self._known = np.zeros((len(of), len(MEASURES))), np.zeros(len(of), bool)

    def means(self, which: np.ndarray) -> np.ndarray:
        """Of the measures over these words."""
        new = np.unique(which[~self._known[which]])
        for part, places in _even(self.start[new], self.end[new] - self.start[new]):
            for i, k in enumerate(MEASURES):
                self._means[new[part], i] = self.numbers[k][places].mean(axis=1)
        self._known[new] = True
        return self._means[which]

    def mean(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Means over n words from the first; 0 of none."""
        total = np.zeros((len(first), len(MEASURES)))
        for i in range(int(n.max(initial=0))):
            more = n > i
            total[more] += self.means(first[more] + i)
        return total / np.maximum(n, 1)[:, None]

    @classmethod
    def of(cls, traces: list[Any]) -> Traces:
        """Of records as `Trace` takes them; one that is null has no text and is not judged."""
        one = [Trace(t if t is not None else dict.fromkeys(("text", "p", "c", "s", "gain", "reuse"))) for t in traces]
        numbers = {k: np.concatenate([np.zeros(0), *(x.numbers[k] for x in one)]) for k in ("p", "c", "s", "gain", "reuse")}
        return cls([x.text for x in one], numbers, np.array([len(x.text) for x in one], np.int64), np.array([x.judged for x in one], bool))

    def floors(self, i: int) -> tuple[float, float]:
        a, b = self.at[i : i + 2]
        return _floors({k: self.numbers[k][a:b] for k in "ps"}, int(b - a))


class Placed(NamedTuple):
    """Where segments lie: a number for all, or one for each pair."""

    image: Any
    border: Any
    left: Any
    source: Any
    line: Any

    def places(self, c: np.ndarray, which: np.ndarray) -> np.ndarray:
        """On the line, of rows of centres of attention of these pairs."""
        image, border, left, source, line = (np.asarray(x)[which, None] if np.ndim(x) else x for x in self)
        inside = np.clip(c * np.maximum(1, image) - border, 0, np.maximum(1, source))
        return np.clip((left + inside) / np.maximum(1, line), 0, 1)


def judge(a: Traces, b: Traces, i: np.ndarray, j: np.ndarray, here: Placed, there: Placed, k: Limits = Limits()) -> list[tuple[Gap | None, list[str]]]:
    """`gap` and, without one, `rejected` of pairs of traces a[i] and b[j], all at once and to the same bit."""
    n_a, n_b = a.first[i + 1] - a.first[i], b.first[j + 1] - b.first[j]
    known = a.judged[i] & b.judged[j]
    enough = known & (n_a >= 2) & (n_b >= 1)
    head = b.mean(b.first[j], np.minimum(n_b, k.anchor))
    go = enough & (head[:, 0] >= k.anchor_p) & (head[:, 1] >= k.anchor_s)
    # the floors of probability and support are within these: medians are taken where they decide
    for x in np.flatnonzero(go & ((head[:, 0] < FLOORS[0][1]) | (head[:, 1] < FLOORS[1][1]))):
        p_floor, s_floor = a.floors(i[x])
        go[x] = head[x, 0] >= p_floor and head[x, 1] >= s_floor

    def limits(ground: np.ndarray) -> tuple[np.ndarray, ...]:
        return k.probability * ground[:, 0], k.support * ground[:, 1], np.maximum(k.coverage_floor, k.coverage * ground[:, 2])

    def low(words: np.ndarray, p: np.ndarray, s: np.ndarray, gain: np.ndarray) -> np.ndarray:
        return (words[:, 1] <= s) & (words[:, 2] <= gain) & ((words[:, 0] <= p) | (words[:, 1] <= k.bare))

    fits: list[tuple[int, list]] = []
    beyond = np.full(len(i), np.nan)
    live = np.flatnonzero(go)
    for n in range(1, k.most + 1):
        # no ground is above the next segment's: an end has only words that are weak against that
        live = live[n_a[live] > n]
        live = live[low(a.means(a.first[i[live] + 1] - n), *limits(np.maximum(1e-6, head[live])))]
        first = a.first[i[live] + 1] - n
        fit = a.start[first] - a.at[i[live]] >= k.prefix
        x, first = live[fit], first[fit]
        back = np.minimum(first - a.first[i[x]], k.anchor)
        ground = np.maximum(1e-6, np.minimum(a.mean(first - back, back), head[x]))
        p, s, gain = limits(ground)
        span = a.mean(first, np.full(len(x), n))
        weak = (span[:, 0] <= p) | (span[:, 1] <= k.bare)
        for m in range(n):
            weak &= low(a.means(first + m), p, s, gain)
        x, first, ground, span = x[weak], first[weak], ground[weak], span[weak]
        start, end = a.start[first], a.end[first + n - 1]
        ends = here.places(a.numbers["c"][np.stack([start, end - 1], axis=1)], x) if len(x) else np.zeros((0, 2))
        idle = (span[:, 3] >= k.reuse) | (np.abs(ends[:, 1] - ends[:, 0]) <= k.progress)
        x, first, ground, span, start, end = (v[idle] for v in (x, first, ground, span, start, end))
        new = x[np.isnan(beyond[x])]
        begin = b.at[j[new]]
        for which, places in _even(begin, b.end[b.first[j[new]] + np.minimum(n_b[new], k.anchor) - 1] - begin):
            beyond[new[which]] = there.places(b.numbers["c"][places], new[which]).mean(axis=1)
        track = np.zeros(len(x))
        for which, places in _even(start, end - start):
            track[which] = here.places(a.numbers["c"][places], x[which]).mean(axis=1)
        score = ground[:, 1] - span[:, 1] + ground[:, 2] - span[:, 2] + span[:, 3]
        held = beyond[x] >= track - k.backtrack
        begin = a.at[i[x]]
        fits.append((n, [v[held].tolist() for v in (x, i[x], start - begin, end - begin, score)]))

    found: dict[int, Gap] = {}
    for n, columns in reversed(fits):  # the longest end that fits
        for x, trace, u, v, score in zip(*columns, strict=True):
            text = a.texts[trace]
            if x not in found and len(prefix := R.nfc(" ".join(text[:u].split()))) >= k.prefix:
                removed = text[u:v].strip()
                found[x] = Gap(prefix, removed, u, v, n, any(map(str.isdigit, removed)), score)

    tail, start = np.minimum(n_a, 3), b.mean(b.first[j], np.minimum(n_b, 2))
    tail = a.mean(a.first[i + 1] - tail, tail)
    held = np.stack([tail[:, 2] >= k.coverage * start[:, 2], tail[:, 1] >= k.support * start[:, 1], tail[:, 3] < k.reuse], axis=1) @ [1, 2, 4]
    why = np.where(known, np.where(enough, held, 8), 9).tolist()
    return [(found[x], []) if x in found else (None, list(REASONS[w])) for x, w in enumerate(why)]


HELD = ("tail_coverage_not_lower", "tail_support_not_lower", "tail_attention_not_reused")
REASONS = [[h for x, h in enumerate(HELD) if w >> x & 1] or ["boundary_not_confident"] for w in range(8)] + [["insufficient_words"], ["coverage_metrics_unavailable"]]

GAP = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "words")), T.StructField("numeric", T.BooleanType()), T.StructField("score", T.DoubleType())])
DIAGNOSTICS = T.StructType([T.StructField(f"{side}_{name}_mean", T.DoubleType()) for side in ("tail", "right") for name in ("probability", "support", "coverage_gain", "reuse_ratio")])
TRACE = "struct<text:string,p:array<double>,c:array<double>,s:array<double>,gain:array<double>,reuse:array<double>,image:int,border:int,left:int,source:int,line:int>"
JUDGED = T.StructType([T.StructField("cut", GAP), T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("diagnostics", DIAGNOSTICS)])


@F.pandas_udf(JUDGED)
def judged(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """cut (null: none), reasons (empty with a cut) and diagnostics of two neighbouring placed traces, structs as `TRACE`; a
    cut that would take digits is reported and not to be made."""
    out = []
    for a, b in zip(left.to_dict("records"), right.to_dict("records"), strict=True):
        cut = gap(a, b)
        out.append((cut and cut._asdict(), [] if cut else rejected(a, b), diagnostics(a, b)))
    return pd.DataFrame(out, columns=["cut", "reasons", "diagnostics"], dtype=object)
