"""Words of Arrow text columns as flat numpy arrays: no Python object per word.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, which in UTF-8 is the same as the run of
characters `[^\\x20\\x09-\\x0D]+`. Words are identified by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _tables[name] = np.cumprod(x, dtype=np.uint64)
    return _tables["up"], _tables["down"]


@dataclass
class Words:
    data: np.ndarray  # the bytes of all texts
    offsets: np.ndarray  # byte offset of each text, and the end
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    bounds: np.ndarray  # index of each text's first word, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """64 bits for each word; fold: A-Z count as a-z."""
        out = np.empty(len(self.starts), np.uint64)
        values, at = _FOLDED if fold else _VALUES, 0
        while at < len(out):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + _SEGMENT, "right")))
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            up, down = _powers(max(int(e[-1]), _SEGMENT))
            total = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(values[self.data[low : low + e[-1]]] * up[: e[-1]], dtype=np.uint64, out=total[1:])
            out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
        return out


def words(texts: pa.Array) -> Words:
    """Of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offset_buffer, data_buffer = arr.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]] if data_buffer else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    full = np.flatnonzero(np.diff(offsets))
    heads, tails = offsets[full], offsets[full + 1] - 1
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; len(h) - k + 1 of them, over text bounds too."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(max(len(h) + 1, _SEGMENT))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], dtype=np.uint64, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])
