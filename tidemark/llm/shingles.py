"""Hashes of five-word shingles of whole texts, a batch at a time in numpy.

Words are runs of anything but the six ASCII white-space characters, so they can be found in the UTF-8
bytes. A word's hash comes from prefix sums of a polynomial modulo 2^64, then mixed; a shingle's hash
from those of its words. A text of one to four words has one shingle, all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text handled at a time; a longer text is handled alone.
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:
    if base not in known or len(known[base]) < n:
        run = np.full(max(n, SLICE), base, np.uint64)
        run[0] = 1
        known[base] = np.cumprod(run, dtype=np.uint64)
    return known[base][:n] if n <= 2 * SLICE else known.pop(base)[:n]


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts and their bounds -> a hash per word, and the bounds of the texts in words."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[:-1][bounds[:-1] < bounds[1:]]  # where a text that is not empty begins
    first[inner] = word[inner]
    last[inner[inner > 0] - 1] = word[inner[inner > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts] if len(starts) else np.zeros(0, np.uint64)
    return mixed(raw + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def _windows(words: np.ndarray) -> np.ndarray:
    n = min(WORDS, len(words))
    h = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        h = h * _STEP + words[i : len(words) - n + 1 + i]
    return mixed(h + np.uint64(n))


def shingle_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles in their order; none for NULL and wordless texts."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    everything = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        bounds = offsets[at : end + 1]
        data = everything[bounds[0] : bounds[-1]]
        if len(data):
            words, text_at = _word_hashes(data, bounds - bounds[0])
            for a, b in zip(text_at[:-1], text_at[1:]):
                yield _windows(words[a:b]) if b > a else words[:0]
        else:
            yield from (np.zeros(0, np.uint64) for _ in range(end - at))
        at = end
