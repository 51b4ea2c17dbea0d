"""A quality classifier: random-indexing vectors pooled per document and a small calibrated network.

Every word gives a form (its hashed lower-case text), a shape (its runs of capitals, small
letters, digits and signs) and a relation (whether it repeats the word before it). Each of them
has a sparse random index vector; a token's context vector is the sum of the index vectors of the
forms, shapes and relations beside it, over every text of the corpus. Tasks add up their own
contexts in a table of fixed size, and Spark sums the tables by blocks, so the vectors cost the
same memory at any size of the corpus.

A document is the mean context vector of its forms, of its shapes and of its repetitions. A
two-layer numpy network is fitted on a bounded sample of labelled documents (``SAMPLE``), and its
logit is divided by a temperature that minimises the log loss of a part set aside. The corpus
statistics and the scores cover all documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoline.llm import shingles as S
from chronoline.llm.common import crc_mod

#: Rows and width of the table of context vectors; non-zero entries of an index vector.
BUCKETS, WIDTH, NONZERO = 1 << 14, 48, 4
#: Rows of the table that are summed together.
BLOCK = 512
#: Labelled documents that the network is fitted on, at most; the part set aside for calibration.
SAMPLE, ASIDE = 20_000, 0.2
#: A label is predicted from this score on.
CUT = 0.7
HIDDEN, STEPS, RATE = 32, 1500, 0.01

_REPEAT, _NEW = np.int64(0), np.int64(1)
_CLASS = np.arange(256, dtype=np.uint8)  # signs stand for themselves
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
_SIGN = np.random.default_rng(99).integers(1, 2**62, 256, dtype=np.uint64) | np.uint64(1)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's non-zero entries."""
    rng = np.random.default_rng(5)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    return places, rng.integers(0, 2, (BUCKETS, NONZERO)) * 2.0 - 1


def streams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Form, shape and relation buckets of all words, and each text's offsets (n + 1)."""
    words, begin = S.word_hashes(raw, at)
    if not len(words):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, begin
    kind = _CLASS[raw]
    second = np.zeros(len(raw), bool)  # capitals of two bytes, as in U+00C0 to U+00DE
    second[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    kind[second] = 1
    kind[:-1][second[1:]] = 1
    inside = ~S._SPACE[raw]
    first = inside.copy()
    edge = np.zeros(len(raw), bool)
    edge[at[:-1][at[:-1] < len(raw)]] = True
    first[1:] &= ~inside[:-1] | edge[1:]
    turn = first.copy()
    turn[1:] |= inside[1:] & (kind[1:] != kind[:-1])
    starts = np.flatnonzero(first)
    place = np.cumsum(turn)
    value = np.where(turn, _SIGN[kind] * S._POWERS[(place - place[starts][np.cumsum(first) - 1]) & 0xFFFF], np.uint64(0))
    value[~inside] = 0
    shapes = S._mix(np.add.reduceat(value, starts))
    repeat = np.zeros(len(words), bool)
    repeat[1:] = words[1:] == words[:-1]
    repeat[begin[:-1][begin[:-1] < len(words)]] = False
    half = np.uint64(BUCKETS // 2)
    forms = (words % (half - np.uint64(2))).astype(np.int64) + 2
    return forms, (shapes % half).astype(np.int64) + BUCKETS // 2, np.where(repeat, _REPEAT, _NEW), begin


def _contexts(forms, shapes, relations, begin, places, signs) -> np.ndarray:
    """The table of context sums of some texts, the neighbours on either side."""
    out = np.zeros(BUCKETS * WIDTH)
    n = len(forms)
    if n < 2:
        return out
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    same = owner[1:] == owner[:-1]
    left, right = np.flatnonzero(same), np.flatnonzero(same) + 1
    for target in (forms, shapes, relations):
        for a, b in ((left, right), (right, left)):
            for source in (forms, shapes, relations):
                slot = (target[a][:, None] * WIDTH + places[source[b]]).ravel()
                out += np.bincount(slot, signs[source[b]].ravel(), BUCKETS * WIDTH)
    return out


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, WIDTH) unit context vectors summed over every text; a table of fixed size."""

    def gather(batches):
        places, signs = _index_vectors()
        total, some = np.zeros(BUCKETS * WIDTH), False
        for b in batches:
            for _, _, raw, at in S.slices(b.column(text)):
                total += _contexts(*streams(raw, at), places, signs)
                some = True
        if some:
            rows = total.astype(np.float32).reshape(-1, BLOCK * WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["block", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK * WIDTH)
        for raw in pdf["sums"]:
            total += np.frombuffer(raw, np.float32)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "sums": [total.astype(np.float32).tobytes()]})

    summed = docs.select(text).mapInArrow(gather, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary")
    table = np.zeros((BUCKETS // BLOCK, BLOCK * WIDTH), np.float32)
    for row in summed.collect():  # BUCKETS rows in all, whatever the corpus
        table[row["block"]] = np.frombuffer(row["sums"], np.float32)
    table = table.reshape(BUCKETS, WIDTH)
    return table / np.maximum(1e-9, np.sqrt((table * table).sum(axis=1, keepdims=True)))


def pooled(raw: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(texts, 3 * WIDTH) mean vectors of forms, shapes and repetitions; zeros without words."""
    forms, shapes, relations, begin = streams(raw, at)
    n = len(begin) - 1
    out = np.zeros((n, 3 * WIDTH), np.float32)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    size = np.diff(begin)[full][:, None]
    for k, stream in enumerate((forms, shapes)):
        out[full, k * WIDTH : (k + 1) * WIDTH] = np.add.reduceat(vectors[stream], begin[:-1][full]) / size
    share = np.add.reduceat((relations == _REPEAT).astype(np.float32), begin[:-1][full])[:, None] / size
    out[full, 2 * WIDTH :] = share * vectors[_REPEAT]
    return out


class Network:
    """Two layers on standardised inputs; a calibrated probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.constant = None
        if not len(y) or len(np.unique(y)) < 2:
            self.constant = 0.5 if not len(y) else float(np.clip(y.mean(), 0.02, 0.98))
            return
        aside = np.zeros(len(y), bool)
        aside[rng.permutation(len(y))[: max(1, int(ASIDE * len(y)))]] = True
        self.mean, self.scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-6
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2, self.temperature = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0, 1.0
        self._fit(x[~aside], y[~aside].astype(float), rng)
        logit = self._logit(x[aside])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, np.where(y[aside] > 0, -logit, logit) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x):
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def _fit(self, x, y, rng):
        z = (x - self.mean) / self.scale
        state = [np.zeros_like(p) for p in (self.w1, self.b1, self.w2, np.zeros(1))]
        second = [s.copy() for s in state]
        for step in range(1, STEPS + 1):
            at = rng.integers(0, len(z), 256)
            h = np.tanh(z[at] @ self.w1 + self.b1)
            off = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - y[at]) / len(at)
            back = np.outer(off, self.w2) * (1 - h * h)
            grads = [z[at].T @ back + 1e-4 * self.w1, back.sum(axis=0), h.T @ off + 1e-4 * self.w2, np.array([off.sum()])]
            moves = []
            for k, g in enumerate(grads):
                state[k] = 0.9 * state[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                moves.append(RATE * (state[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
            self.w1, self.b1, self.w2, self.b2 = self.w1 - moves[0], self.b1 - moves[1], self.w2 - moves[2], self.b2 - float(moves[3][0])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit(x.astype(float)) / self.temperature, -35, 35)))


def _map_pooled(docs: DataFrame, text: str, vectors: np.ndarray, name: str, kind: str, finish):
    """The columns of ``docs`` but the text, with ``finish`` of the pooled vectors as a new column."""
    kept = [c for c in docs.columns if c not in (text, name)]

    def run(batches):
        for b in batches:
            found = [pooled(raw, at, vectors) for _, _, raw, at in S.slices(b.column(text))]
            x = np.concatenate(found) if found else np.zeros((0, 3 * WIDTH), np.float32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), finish(x)], [*kept, name])

    schema = docs.select(*kept, F.lit(None).cast(kind).alias(name)).schema
    return docs.select(*kept, text).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, text: str = "text", ident: str = "doc_id", label: str = "quality") -> Network:
    """A network fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of their ids.

    Rows without a label of 0 or 1 or with a null id are left out. Without labels every score is
    0.5; with one class alone, every score is its clipped share.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull()).select(ident, F.col(label).cast("int").alias("_y")).distinct()
    some = known.orderBy(F.xxhash64(ident, F.lit(17)), ident, "_y").limit(SAMPLE)
    rows = docs.select(ident, text).join(F.broadcast(some), ident)  # at most SAMPLE rows
    found = _map_pooled(rows, text, vectors, "x", "binary", lambda x: pa.array([r.tobytes() for r in x], pa.binary()))
    got = found.orderBy(F.xxhash64(ident, F.lit(18)), ident, "_y", "x").limit(SAMPLE).select("_y", "x").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float32).reshape(-1, 3 * WIDTH)
    return Network(x.astype(float), np.array([r["_y"] for r in got]))


def score(docs: DataFrame, network: Network, vectors: np.ndarray, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ``score``; null and empty texts have no vectors but a score too."""
    return _map_pooled(docs, text, vectors, "score", "double", lambda x: pa.array(network(x), pa.float64()))


def held_out_quality(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", folds: int = 4, fold: int = 2) -> DataFrame:
    """(ident, held_out, score, predicted) of all documents, fitted on labels outside one fold."""
    vectors = context_vectors(docs, text)
    network = fit(docs, labels.where(crc_mod(F.col(ident), folds) != fold), vectors, text, ident)
    rows = docs.select(ident, text, (crc_mod(F.col(ident), folds) == fold).alias("held_out"))
    return score(rows, network, vectors, text).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
