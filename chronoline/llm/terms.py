"""Terms of whole Arrow batches with numpy: runs of letters, digits and non-ASCII characters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronoline.llm.common import ascii_lower

#: A term after A-Z are lowered, and what stands between terms, as Java and RE2 write them.
TERM, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_rng = np.random.default_rng(20240611)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: A-Z lowered; every byte between terms is a space. Bytes of non-ASCII characters stay.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, _BASE, np.uint64))


def spaced_terms(text: Column) -> Column:
    """A text's terms, each followed by one space; null is empty."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, " "))
    return F.when(plain == "", "").otherwise(F.concat(plain, F.lit(" ")))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Terms:
    """The terms of concatenated texts: hash, first byte and end of each, and where each text's begin (n + 1)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.plain = _PLAIN[raw]
        inside = self.plain != 32
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.first, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.begin = np.searchsorted(self.first, at)
        self.hash = np.zeros(0, np.uint64)
        if len(self.first):
            place = np.zeros(len(raw), np.int64)
            lead = self.first[0]
            place[lead:] = np.arange(lead, len(raw)) - np.repeat(self.first, np.diff(np.append(self.first, len(raw))))
            value = _VALUE[self.plain] * _POWERS[place & 0xFFFF]
            value[~inside] = 0
            self.hash = mix(np.add.reduceat(value, self.first))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, places): the hash of every ``width`` consecutive terms of a text and the first term's number."""
        n = len(self.hash)
        rest = np.repeat(self.begin[1:], np.diff(self.begin)) - np.arange(n)
        at = np.flatnonzero(rest >= width)
        rolled = np.full(len(at), width, np.uint64)
        for k in range(width):
            rolled += self.hash[at + k] * _POWERS[k]
        return mix(rolled).view(np.int64), at

    def slices(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, bytes) of the plain text from term ``low`` up to, not with, term ``high``; empty if equal."""
        some = high > low
        a = np.zeros(len(low), np.int64)
        size = np.zeros(len(low), np.int64)
        a[some] = self.first[low[some]]
        size[some] = self.end[high[some] - 1] - a[some]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ends, self.plain[np.arange(ends[-1]) + np.repeat(a - ends[:-1], size)]


class Sieve:
    """A bit set over 64-bit keys, sent to the tasks once: every key of the set passes, few others do.

    Its size follows the number of keys, from 16 KB up to ``2 ** MOST`` bits (32 MB).
    """

    LEAST, MOST = 17, 28

    def __init__(self, spark: SparkSession, keys: DataFrame, column: str):
        n = keys.count()
        self.bits = max(self.LEAST, min(self.MOST, (16 * max(n, 1)).bit_length()))
        place = F.shiftrightunsigned(F.col(column), 64 - self.bits) + 1  # these buckets count from one
        blocks = keys.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        data = bytearray((1 << self.bits) // 8)
        for r in blocks.toLocalIterator():  # at most 2 ** (MOST - 15) blocks of 4 KB
            at = (r["at"] - 1) * 4096
            data[at : at + 4096] = r["bits"]
        self.sent = spark.sparkContext.broadcast(bytes(data))

    def __getstate__(self):
        return {"bits": self.bits, "sent": self.sent}

    def passes(self, keys: np.ndarray) -> np.ndarray:
        data = np.frombuffer(self.sent.value, np.uint8)
        place = keys.view(np.uint64) >> np.uint64(64 - self.bits)
        return (data[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
