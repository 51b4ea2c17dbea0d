"""Interpolated modified Kneser-Ney bigrams, counted in Spark and kept as sorted hash arrays.

Every text is read as its words, A-Z in lower case, and one end token, which is also the context
of the next text's first word. Tasks count hashed tokens, then pairs, of their own texts and send
sorted, difference-coded arrays to the part that each key belongs to; a part merges what it gets
and writes its arrays to the shared folder. Workers map those files into memory and look keys up
by binary search, so no worker holds the model and nothing of it passes the driver but one row of
sums per part.

``words`` parts are ranges of the token hash: keys, counts, continuation counts and, as contexts,
the numbers of followers seen once, twice and more often. A token's number is its place in that
order. ``pairs`` parts are hash classes of (context, slice): a frequent context's followers are
cut into as many slices as its count asks for, so no part holds more than about
``PART_TOKENS`` pairs, however frequent a word is.

The order is two: trigrams of this corpus would be nearly as many as its tokens, and their
shuffle and arrays more than the work space allows.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoline.llm import shingles as S
from chronoline.llm.common import crc_mod
from chronoline.session import scratch_path, settle

#: Rows of the training table to a part of the words, at least eight parts.
PART_DOCS, PART_TOKENS, MAX_PARTS = 1_000_000, 2_000_000, 65_536
#: Pairs that a task gathers before it sends them.
HELD = 3_000_000
_END = np.uint64(0xE0D0C0B0A0908071)


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def save_array(uri: str, values: np.ndarray) -> None:
    """Write an array's bytes in one step: a task that is run twice writes the same file."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        values.tofile(part)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(where) as f:
        f.write(np.ascontiguousarray(values).tobytes())


def map_array(uri: str, kind) -> np.ndarray:
    """The array as a memory map; in a store that can't be mapped, it is read."""
    path = _local(uri)
    if path is not None:
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(uri)
    with store.open_input_file(where) as f:
        return np.frombuffer(f.read(), kind)


def _pack(sorted_keys: np.ndarray) -> bytes:
    """Differences of sorted keys with equal bytes together, which the shuffle's codec shortens."""
    step = np.diff(sorted_keys, prepend=np.uint64(0)).astype(np.uint64)
    return step.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of concatenated texts, an end token after each, and offsets (n + 1)."""
    words, begin = S.word_hashes(raw, at)
    n = len(at) - 1
    ends = begin + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends[1:] - 1] = True
    out[is_end], out[~is_end] = _END, words
    return out, ends


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the sums that scores need."""

    path: str
    bits: int
    bases: tuple[int, ...]
    n_tokens: int
    n_types: int
    pair_parts: int
    slice_tokens: int
    pair_discounts: tuple[float, ...] = ()
    word_discounts: tuple[float, ...] = ()
    n_pairs: int = 0
    word_rest: float = 0.0

    def words(self, name: str, part: int, kind) -> np.ndarray:
        return map_array(f"{self.path}/words/{part}.{name}", kind)


class Words:
    """Look-ups in the mapped word arrays of a model, by part."""

    def __init__(self, model: Model, names: dict[str, type]):
        self.model = model
        self.keys = [model.words("keys", r, np.uint64) for r in range(len(model.bases))]
        self.values = {n: [model.words(n, r, k) for r in range(len(model.bases))] for n, k in names.items()}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Token numbers (-1: unknown) of sorted keys, and their values (0 where unknown)."""
        number = np.full(len(keys), -1, np.int64)
        values = {n: np.zeros(len(keys), np.int64) for n in self.values}
        cuts = np.searchsorted(keys >> np.uint64(64 - self.model.bits), np.arange(len(self.keys) + 1, dtype=np.uint64))
        for r, have in enumerate(self.keys):
            own = slice(cuts[r], cuts[r + 1])
            if cuts[r] == cuts[r + 1] or not len(have):
                continue
            at = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
            hit = have[at] == keys[own]
            number[own] = np.where(hit, at + self.model.bases[r], -1)
            for n, arrays in self.values.items():
                values[n][own] = np.where(hit, arrays[r][at], 0)
        return number, values


def _pair_part(model: Model, context: np.ndarray, context_count: np.ndarray, word: np.ndarray) -> np.ndarray:
    slices = 1 + context_count // model.slice_tokens
    piece = (word * slices) // max(1, model.n_types)
    mixed = S._mix(context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64))
    return (mixed % np.uint64(model.pair_parts)).astype(np.int64)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of entries counted once to four times.

    Where these are too few for the closed form, half of each count is taken.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] and n[k] else k / 2
        out.append(min(float(k), max(0.0, d)))
    return tuple(out)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts as 32 bits; larger ones are an error, never cut."""
    if len(counts) and int(counts.max()) >= 2**32:
        raise ValueError("a pair of words occurs 2**32 times or more: its count needs wider arrays")
    return counts.astype(np.uint32)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count a model over every row of ``docs``; null and empty texts are one end token each."""
    spark = docs.sparkSession
    path = scratch_path(spark)
    docs = docs.select(F.coalesce(text, F.lit("")).alias("text"))
    rows = docs.count()
    bits = max(3, (max(1, rows // PART_DOCS) - 1).bit_length())

    def count_words(batches):
        held: list[tuple] = []

        def flush():
            keys, counts = _sum_by_key(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
            full = [r for r in range(2**bits) if cuts[r] < cuts[r + 1]]
            return pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array([_pack(keys[cuts[r] : cuts[r + 1]]) for r in full], pa.binary()), pa.array([_pack_counts(counts[cuts[r] : cuts[r + 1]]) for r in full], pa.binary()),
            ], ["part", "keys", "counts"])

        for b in batches:
            for _, _, raw, at in S.slices(b.column("text")):
                held.append(np.unique(tokens(raw, at)[0], return_counts=True))
                if sum(len(k) for k, _ in held) > HELD:
                    yield flush()
        if held:
            yield flush()

    def merge_words(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["part"].iloc[0])
        keys, counts = _sum_by_key(np.concatenate([_unpack(k) for k in pdf["keys"]]), np.concatenate([_unpack_counts(c) for c in pdf["counts"]]))
        save_array(f"{path}/words/{r}.keys", keys)
        save_array(f"{path}/words/{r}.counts", counts)
        return pd.DataFrame({"part": [r], "n": [len(keys)], "total": [int(counts.sum())]})

    sent = docs.mapInArrow(count_words, "part int, keys binary, counts binary")
    found = sent.repartition(2**bits, "part").groupBy("part").applyInPandas(merge_words, "part int, n long, total long").collect()  # one row a part
    sizes, total = np.zeros(2**bits, np.int64), 0
    for r in found:
        sizes[r["part"]] = r["n"]
        total += r["total"]
    for r in np.flatnonzero(sizes == 0):  # parts that no key fell into
        for name, kind in (("keys", np.uint64), ("counts", np.int64)):
            save_array(f"{path}/words/{r}.{name}", np.zeros(0, kind))
    types = int(sizes.sum())
    if types >= 2**31:
        raise ValueError("more than 2**31 different tokens: their pairs need wider keys")
    bases = tuple(int(x) for x in np.cumsum(sizes) - sizes)
    pair_parts = max(1, min(MAX_PARTS, total // PART_TOKENS + 1))
    model = Model(path, bits, bases, total, types, pair_parts, max(PART_TOKENS // 4, total // pair_parts // 4))

    def count_pairs(batches):
        words = Words(model, {"counts": np.int64})
        held: list[tuple] = []

        def flush():
            keys, counts = _sum_by_key(np.concatenate([k for k, _, _ in held]), np.concatenate([c for _, c, _ in held]))
            pairs = dict_part(keys)
            held.clear()
            order = np.argsort(pairs, kind="stable")
            keys, counts, pairs = keys[order], counts[order], pairs[order]
            cuts = np.searchsorted(pairs, np.arange(model.pair_parts + 1))
            full = [p for p in range(model.pair_parts) if cuts[p] < cuts[p + 1]]
            return pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array([_pack(keys[cuts[p] : cuts[p + 1]]) for p in full], pa.binary()), pa.array([_pack_counts(counts[cuts[p] : cuts[p + 1]]) for p in full], pa.binary()),
            ], ["part", "keys", "counts"])

        def dict_part(keys):
            context = (keys // np.uint64(model.n_types)).astype(np.int64)
            word = (keys % np.uint64(model.n_types)).astype(np.int64)
            count = np.zeros(len(keys), np.int64)
            for r, base in enumerate(model.bases):
                own = (context >= base) & (context < base + len(words.keys[r]))
                count[own] = words.values["counts"][r][context[own] - base]
            return _pair_part(model, context, count, word)

        for b in batches:
            for _, _, raw, at in S.slices(b.column("text")):
                got, _ = tokens(raw, at)
                keys, back = np.unique(got, return_inverse=True)
                number, _ = words.find(keys)
                number = number[back]
                # every text ends with the end token, which is the next one's context
                context = np.concatenate([[number[-1]], number[:-1]])
                pair, counts = np.unique(context.astype(np.uint64) * np.uint64(model.n_types) + number.astype(np.uint64), return_counts=True)
                held.append((pair, counts, None))
                if sum(len(k) for k, _, _ in held) > HELD:
                    yield flush()
        if held:
            yield flush()

    part_of = np.array([*bases, types], np.int64)

    def merge_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(pdf["part"].iloc[0])
        keys, counts = _sum_by_key(np.concatenate([_unpack(k) for k in pdf["keys"]]), np.concatenate([_unpack_counts(c) for c in pdf["counts"]]))
        save_array(f"{path}/pairs/{p}.keys", keys)
        save_array(f"{path}/pairs/{p}.counts", narrow(counts))
        context, word = keys // np.uint64(types), keys % np.uint64(types)
        out = []

        def send(kind, numbers, sums):
            numbers, sums = _sum_by_key(numbers, sums)
            cuts = np.searchsorted(numbers.astype(np.int64), part_of)
            out.extend((r, kind, _pack(numbers[cuts[r] : cuts[r + 1]]), _pack_counts(sums[cuts[r] : cuts[r + 1]])) for r in range(len(bases)) if cuts[r] < cuts[r + 1])

        send("cont", word, np.ones(len(word), np.int64))
        for kind, own in (("once", counts == 1), ("twice", counts == 2), ("more", counts > 2)):
            send(kind, context[own], np.ones(int(own.sum()), np.int64))
        out.append((-1, "seen", b"", np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes()))
        return pd.DataFrame(out, columns=["part", "kind", "keys", "counts"])

    def merge_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["part"].iloc[0])
        if r < 0:
            n = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
            return pd.DataFrame({"part": [r], "n1": [n[0]], "n2": [n[1]], "n3": [n[2]], "n4": [n[3]], "above": [0], "total": [0]})
        cont = np.zeros(0, np.int64)
        for kind in ("cont", "once", "twice", "more"):
            dense = np.zeros(sizes[r], np.uint32)
            for k, c in pdf.loc[pdf["kind"] == kind, ["keys", "counts"]].itertuples(index=False):
                dense[_unpack(k).astype(np.int64) - bases[r]] += _unpack_counts(c)
            save_array(f"{path}/words/{r}.{kind}", dense)
            cont = dense if kind == "cont" else cont
        n = [int((cont == k).sum()) for k in (1, 2, 3, 4)]
        return pd.DataFrame({"part": [r], "n1": [n[0]], "n2": [n[1]], "n3": [n[2]], "n4": [n[3]], "above": [int((cont > 2).sum())], "total": [int(cont.sum())]})

    sent = docs.mapInArrow(count_pairs, "part int, keys binary, counts binary")
    sums = settle(sent.repartition(pair_parts, "part").groupBy("part").applyInPandas(merge_pairs, "part int, kind string, keys binary, counts binary"))
    rows = sums.repartition(len(bases) + 1, "part").groupBy("part").applyInPandas(merge_sums, "part int, n1 long, n2 long, n3 long, n4 long, above long, total long").collect()  # one row a part
    pairs = next((r for r in rows if r["part"] < 0), None)
    for r in set(range(len(bases))) - {r["part"] for r in rows}:
        for kind in ("cont", "once", "twice", "more"):
            save_array(f"{path}/words/{r}.{kind}", np.zeros(sizes[r], np.uint32))
    for p in set(range(pair_parts)) - {r["part"] for r in sums.where("kind = 'seen'").select("part").collect()} if pairs is None else ():
        save_array(f"{path}/pairs/{p}.keys", np.zeros(0, np.uint64))
    word_n = [sum(r[f"n{k}"] for r in rows if r["part"] >= 0) for k in (1, 2, 3, 4)]
    n_pairs, above = (sum(r[c] for r in rows if r["part"] >= 0) for c in ("total", "above"))
    d = _discounts(word_n)
    rest = (d[0] * word_n[0] + d[1] * word_n[1] + d[2] * above) / n_pairs if n_pairs else 1.0
    pair_d = _discounts([pairs[f"n{k}"] for k in (1, 2, 3, 4)] if pairs else [0] * 4)
    return Model(path, bits, bases, total, types, pair_parts, model.slice_tokens, pair_d, d, n_pairs, rest)


class Scorer:
    """Base and model scores of texts, from the mapped arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Words(model, {"counts": np.int64, "cont": np.uint32, "once": np.uint32, "twice": np.uint32, "more": np.uint32})
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def pair_counts(self, context: np.ndarray, context_count: np.ndarray, word: np.ndarray) -> np.ndarray:
        """How often known words follow known contexts."""
        m = self.model
        part = _pair_part(m, context, context_count, word)
        keys = context.astype(np.uint64) * np.uint64(max(1, m.n_types)) + word.astype(np.uint64)
        order = np.lexsort((keys, part))
        out = np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(part[order], np.arange(m.pair_parts + 1))
        for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
            if p not in self.pairs:
                there = _local(m.path) is None or os.path.exists(f"{_local(m.path)}/pairs/{p}.keys")
                self.pairs[p] = tuple(map_array(f"{m.path}/pairs/{p}.{n}", k) for n, k in (("keys", np.uint64), ("counts", np.uint32))) if there else (np.zeros(0, np.uint64),) * 2
            have, counts = self.pairs[p]
            if not len(have):
                continue
            own = order[cuts[p] : cuts[p + 1]]
            at = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
            out[own] = np.where(have[at] == keys[own], counts[at], 0)
        return out

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        m = self.model
        got, ends = tokens(raw, at)
        keys, back = np.unique(got, return_inverse=True)
        number, v = self.words.find(keys)
        base = np.log10((v["counts"] + 0.5) / (m.n_tokens + 0.5 * (m.n_types + 1)))
        cut = np.array([0.0, *(m.word_discounts or (0, 0, 0))])
        lower = m.word_rest / (m.n_types + 1) + np.maximum(0, v["cont"] - cut[np.minimum(v["cont"], 3)]) / max(1, m.n_pairs)
        d = m.pair_discounts or (0.0, 0.0, 0.0)
        left = d[0] * v["once"] + d[1] * v["twice"] + d[2] * v["more"]
        end = np.searchsorted(keys, _END)
        before = np.empty_like(back)
        before[1:] = back[:-1]
        before[ends[:-1]] = end  # a text begins after an end
        pair, again = np.unique(before * np.int64(len(keys)) + back, return_inverse=True)
        h, w = pair // len(keys), pair % len(keys)
        p = lower[w]
        ok = v["counts"][h] > 0
        both = np.flatnonzero(ok & (number[w] >= 0))
        c = np.zeros(len(pair), np.int64)
        if len(both):
            c[both] = self.pair_counts(number[h[both]], v["counts"][h[both]], number[w[both]])
        taken = np.maximum(0, c - np.array([0.0, *d])[np.minimum(c, 3)])
        p = np.where(ok, (taken + left[h] * p) / np.maximum(1, v["counts"][h]), p)
        add = lambda x: np.add.reduceat(x, ends[:-1])
        return np.diff(ends), add((v["counts"] > 0)[back].astype(np.int64)), add(base[back]), add(np.log10(p)[again])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with n_tokens, n_known, base_score and score.

    Scores are log10 probabilities of whole texts with their end; null and empty texts are the
    end alone. Tokens that the model doesn't know share one place in its vocabulary. Columns with
    the new names are replaced.
    """
    new = ["n_tokens", "n_known", "base_score", "score"]
    kept = [c for c in docs.columns if c not in new and c != text]

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            found = [scorer(raw, at) for _, _, raw, at in S.slices(b.column(text))]
            cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(4)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*kept, *new])

    schema = docs.select(*kept, F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema
    return docs.select(*kept, text).mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, ident: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """Scores of all documents by a model of those outside one fold, crc32 of the id mod ``folds``."""
    out = (crc_mod(F.col(ident), folds) == fold)
    model = train(docs.where(~out), text)
    scored = score(docs.select(ident, text, out.alias("held_out")), model, text)
    return scored.withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
