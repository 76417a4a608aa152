"""Words of whole texts, split and numbered for a batch at a time with numpy.

A word is a run of bytes other than the space and \\t \\n \\v \\f \\r, which in
UTF-8 is the same as a run of such characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_PAD = 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


@dataclass
class Words:
    """buf: the batch's UTF-8 bytes and some padding; starts and lengths: each word's bytes; bounds: document k has words bounds[k]:bounds[k + 1]; offsets: its bytes."""

    buf: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word among the batch's distinct words, first place of each distinct word)."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wide = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, 0, (1,))
        keys, mixed = [], self.lengths.astype(np.uint64) * _MIX[0]
        longest = int(self.lengths.max())
        for k in range(min(4, -(-longest // 8))):
            size = np.clip(self.lengths - 8 * k, 0, 8)
            keys.append(wide[np.minimum(self.starts + 8 * k, len(wide) - 1)] & _MASKS[size])
            mixed ^= keys[-1] * _MIX[k]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[3 - k]
        if longest > 32:
            raw = self.buf.tobytes()
            for i in np.flatnonzero(self.lengths > 32).tolist():
                mixed[i] = hash(raw[self.starts[i] : self.starts[i] + self.lengths[i]]) & 0xFFFFFFFFFFFFFFFF
        codes, distinct = pd.factorize(mixed)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(n - 1, -1, -1)
        same = self.lengths == self.lengths[first][codes]
        for key in keys:
            same &= key == key[first][codes]
        if same.all() and longest <= 32:
            return codes, first
        return self._by_bytes() if longest > 32 and not self._long_agree(codes, first) or not same.all() else (codes, first)

    def _long_agree(self, codes: np.ndarray, first: np.ndarray) -> bool:
        raw = self.buf.tobytes()
        word = lambda i: raw[self.starts[i] : self.starts[i] + self.lengths[i]]
        return all(word(i) == word(first[codes[i]]) for i in np.flatnonzero(self.lengths > 32).tolist())

    def _by_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The same by comparing whole words, for batches in which two words' mixed keys are equal."""
        seen: dict[bytes, int] = {}
        codes = np.array([seen.setdefault(w, len(seen)) for w in self.at(range(len(self.starts)))], np.int64)
        first = np.empty(len(seen), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        return codes, first

    def at(self, places) -> list[bytes]:
        """The words at some places."""
        raw = self.buf.tobytes()
        starts = self.starts[places] if isinstance(places, np.ndarray) else self.starts
        lengths = self.lengths[places] if isinstance(places, np.ndarray) else self.lengths
        return [raw[a:b] for a, b in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)]


def split_words(texts: pa.Array | pa.ChunkedArray, lower: bool = False, outside: np.ndarray = _IS_SPACE) -> Words:
    """The words of a batch of texts, A-Z in lower case if ``lower``; a null text has none. ``outside`` says of each byte whether it stands between words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    buf = np.zeros(size + _PAD + 8, np.uint8)
    if size:
        buf[:size] = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0]))
    if lower:
        buf = _LOWER[buf]
    offsets = offsets - offsets[0]
    inside = ~outside[buf[:size]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[offsets < size]
    begins[edges] |= inside[edges]
    edges = edges[edges > 0] - 1
    ends[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    return Words(buf, starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, offsets), offsets)
