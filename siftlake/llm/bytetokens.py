"""Tokens of whole text batches by array arithmetic on their UTF-8 bytes.

A token is a match of ``[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\r\\n]``: a run of word characters
or one other character that is no blank. Everything works on the bytes of an Arrow string
array at once; no text is turned into Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; keeps the working arrays in cache.
SLICE_BYTES = 1 << 20

_BLANK, _WORD, _OTHER, _REST = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[9, 10, 13, 32]] = _BLANK
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = _WORD
_KIND[95] = _WORD
_KIND[0x80:0xC0] = _REST  # continuation bytes belong to the character before

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = _mix(_LOWER + np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C55)


@dataclass
class Tokens:
    """Tokens of consecutive texts: ``first[i]`` to ``first[i + 1]`` are those of text i."""

    first: np.ndarray
    start: np.ndarray
    data: np.ndarray
    kind: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, values: np.ndarray = _VALUE) -> np.ndarray:
        """64 bits per token of its text with A-Z lowered; ``values`` maps a byte to its part."""
        if not len(self.start):
            return np.empty(0, dtype=np.uint64)
        inked = np.flatnonzero(self.kind)
        begins = np.searchsorted(inked, self.start)
        length = np.diff(np.append(begins, len(inked)))
        place = np.arange(len(inked)) - np.repeat(begins, length)
        powers = np.cumprod(np.full(int(length.max()), _BASE, dtype=np.uint64))
        return _mix(np.add.reduceat(values[self.data[inked]] * powers[place], begins))


def _scan(data: np.ndarray, ends: np.ndarray) -> Tokens:
    kind = _KIND[data]
    word = kind == _WORD
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    begins = ends[:-1][ends[:-1] < ends[1:]]
    starts[begins] |= word[begins]  # a text begins anew even if the last one ended in a word
    start = np.flatnonzero(starts | (kind == _OTHER))
    return Tokens(np.searchsorted(start, ends), start, data, kind)


def scan(texts: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """(index of the first text, its tokens) for slices of an Arrow string array; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, _scan(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
        at = upto


def token_counts(texts: pa.Array) -> np.ndarray:
    parts = [t.counts() for _, t in scan(texts)]
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, dtype=np.int64)
