"""Hashed word shingles and MinHash values of whole Arrow batches, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from chronoline.llm.common import ascii_lower

#: Words of a shingle.
WIDTH = 5
#: Bytes of text handled at a time; a longer text is handled alone.
SLICE = 1 << 21

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, _BASE, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_key(text: Column) -> Column:
    """A 64-bit key of a text's words, letter case of A-Z and white space aside; null is empty."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    return F.xxhash64(plain)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of concatenated texts, and where each text's words start (n + 1 offsets)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw), bool)
    edge[at[:-1][at[:-1] < len(raw)]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    place = np.arange(len(raw), dtype=np.int64)
    number = np.cumsum(first) - 1
    place -= starts[np.maximum(number, 0)]
    value = _BYTE[raw] * _POWERS[place & 0xFFFF]
    value[~inside] = 0
    sums = np.add.reduceat(value, starts)
    return _mix(sums), np.searchsorted(starts, at)


def shingle_hashes(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order, repeats kept, and each text's offsets (n + 1).

    A text of fewer than ``width`` words has one shingle, all its words; one without words none.
    """
    words, begin = word_hashes(raw, at)
    n = len(words)
    count = np.diff(begin)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        if n > k:
            rolled[: n - k] += words[k:] * _POWERS[k]
    rolled = _mix(rolled)
    take = np.maximum(count - width + 1, 0)
    short = np.flatnonzero((count > 0) & (count < width))
    take[short] = 1
    for d in short:  # fewer than width words: at most width - 1 steps each
        own = words[begin[d] : begin[d + 1]]
        rolled[begin[d]] = _mix(np.array([np.sum(own * _POWERS[100 : 100 + len(own)], dtype=np.uint64)], np.uint64))[0]
    ends = np.concatenate([[0], np.cumsum(take)])
    index = np.arange(ends[-1]) - np.repeat(ends[:-1], take) + np.repeat(begin[:-1], take)
    return rolled[index], ends


def slices(texts: pa.Array, size: int = SLICE):
    """Pieces (first, last, bytes, offsets) of an Arrow text array, of about ``size`` bytes; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def minhash(shingles: np.ndarray, ends: np.ndarray, hashes: int) -> np.ndarray:
    """(texts, hashes) MinHash values cut to 16 bits; texts without shingles get zeros."""
    out = np.zeros((len(ends) - 1, hashes), np.uint16)
    full = np.flatnonzero(np.diff(ends))
    if not len(full):
        return out
    rng = np.random.default_rng(77)
    odd = rng.integers(1, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 2**32, hashes, dtype=np.uint32)
    base, starts = (shingles >> np.uint64(32)).astype(np.uint32), ends[:-1][full]
    for k in range(hashes):
        least = np.minimum.reduceat((base ^ flip[k]) * odd[k], starts)
        out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out
