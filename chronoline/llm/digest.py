"""Document fingerprints: a digest of bucket quartiles with a bounded difference score.

Every window of four bytes of the UTF-8 text gives three byte triplets, hashed into 256 buckets.
A bucket is coded 0 to 3 by the quartile of the text's own bucket counts that its count falls
into. The digest is the logarithm of the length (one byte) and the codes (64 bytes), in hex. Two
digests differ by the sum of their code differences plus a part for the length; ``likeness`` is
1 at no difference and 0 at ``BOUND``, about what unrelated random codes differ by, or more.

The work is done over whole Arrow batches with numpy; memory is bounded by a slice of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 256
BOUND = 320.0
#: At most so much of a difference comes from the lengths.
LENGTH_PART = 40
#: Bytes of text handled at a time; a longer text is handled alone.
SLICE = 1 << 22
#: Rows of one block of neighbours, about, and the most blocks.
BLOCK_ROWS, MAX_BLOCKS = 400, 4096


def _count(data: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """(docs, BUCKETS) triplet counts of concatenated texts; doc numbers the text of each byte."""
    out = np.zeros(docs * BUCKETS, np.int64)
    if len(data) < 3:
        return out.reshape(docs, BUCKETS)
    b = data.astype(np.uint32)
    for i, j, salt in ((1, 2, 0x9E3779B1), (1, 3, 0x85EBCA6B), (2, 3, 0xC2B2AE35)):
        n = len(b) - j
        if n <= 0:
            continue
        mixed = (b[:n] | (b[i : i + n] << np.uint32(8)) | (b[j:] << np.uint32(16))) * np.uint32(salt)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        slot = (mixed >> np.uint32(24)).astype(np.int64) + doc[:n] * BUCKETS
        out += np.bincount(slot[doc[:n] == doc[j:]], minlength=len(out))
    return out.reshape(docs, BUCKETS)


def _codes(counts: np.ndarray) -> np.ndarray:
    cut = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
    return sum((counts > cut[:, [q * BUCKETS // 4 - 1]]).astype(np.uint8) for q in (1, 2, 3))


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, 256) and length bytes (n) of texts; null counts as the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    codes, lengths = np.zeros((n, BUCKETS), np.uint8), np.zeros(n, np.uint8)
    if not n:
        return codes, lengths
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, side="right")) - 1)
        size = np.diff(at[first : last + 1])
        piece = raw[at[first] : at[last]]
        codes[first:last] = _codes(_count(piece, np.repeat(np.arange(last - first), size), last - first))
        lengths[first:last] = np.minimum(255, np.round(np.log1p(size) * 8)).astype(np.uint8)
        first = last
    return codes, lengths


def to_hex(codes: np.ndarray, lengths: np.ndarray) -> list[str]:
    quads = codes.reshape(len(codes), BUCKETS // 4, 4)
    body = quads[:, :, 0] << 6 | quads[:, :, 1] << 4 | quads[:, :, 2] << 2 | quads[:, :, 3]
    return [x.tobytes().hex() for x in np.concatenate([lengths[:, None], body], axis=1)]


def from_hex(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(prints)), np.uint8).reshape(len(prints), 1 + BUCKETS // 4)
    body = raw[:, 1:]
    return np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=2).reshape(len(prints), BUCKETS), raw[:, 0].copy()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal digests, falling to 0 at a difference of ``BOUND``; symmetric."""
    off = np.abs(a[0].astype(np.int16) - b[0]).sum(axis=1)
    off = off + np.minimum(LENGTH_PART, np.abs(a[1].astype(np.int16) - b[1]))
    return np.maximum(0.0, 1.0 - off / BOUND)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The columns of ``docs`` but the text, and the fingerprint of each whole text."""
    kept = [c for c in docs.columns if c not in (text, name)]

    def run(batches):
        for b in batches:
            prints = to_hex(*digests(b.column(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(prints, pa.string())], [*kept, name])

    schema = docs.select(*kept, F.lit("").alias(name)).schema
    return docs.select(*kept, text).mapInArrow(run, schema)


def compare(left: Column, right: Column) -> Column:
    """Likeness of two fingerprint columns; null if either is null."""

    @F.pandas_udf("double")
    def near(a, b):
        import pandas as pd

        out, known = pd.Series([None] * len(a), dtype="float64"), (a.notna() & b.notna()).to_numpy()
        if known.any():
            out[known] = likeness(from_hex(a[known].tolist()), from_hex(b[known].tolist()))
        return out

    return near(left, right)


def with_next(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(ident, text, _block, _seq, _peek): documents in ascending id order, cut into blocks.

    Blocks start at quantiles of the ids. The document that starts a block is also the last row,
    marked ``_peek``, of the block before it (the very first one: of the last block), so a row's
    next document is always the next row of its block: one exchange of the texts, no window over
    all rows. Null ids come last, equal ids in the order of a hash of their texts; null texts
    count as empty.
    """
    base = docs.select(ident, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(ident).cast("long"), F.lit(2**63 - 1)).alias("_k"))
    keys = base.select("_k")
    rows = keys.count()
    n = max(1, min(MAX_BLOCKS, -(-rows // BLOCK_ROWS)))
    cuts = keys.approxQuantile("_k", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    # quantiles come as doubles; the blocks' own smallest ids are the edges
    near = F.array(F.lit(-(2.0**63)), *(F.lit(float(c)) for c in sorted(set(cuts))))
    firsts = keys.groupBy(F.array_size(F.filter(near, lambda e: e <= F.col("_k").cast("double"))).alias("b")).agg(F.min("_k").alias("k"))
    edges = sorted(r["k"] for r in firsts.collect()) or [0]  # at most MAX_BLOCKS rows
    listed = F.array(*(F.lit(e).cast("long") for e in edges))
    base = base.withColumn("_block", F.array_size(F.filter(listed, lambda e: e <= F.col("_k"))) - 1)
    before = F.when(F.array_contains(listed, F.col("_k")), F.pmod(F.col("_block") - 1, F.lit(len(edges))))
    both = F.array(F.struct(F.col("_block"), F.lit(False).alias("_peek")), F.struct(before.alias("_block"), F.lit(True).alias("_peek")))
    places = F.filter(both, lambda p: p["_block"].isNotNull())
    return base.withColumn("_p", F.explode(places)).select(ident, "text", "_k", "_p._block", "_p._peek")


def edited_fingerprints(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and what both are like.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many
    of the next document. With one document, it is its own next. Equal ids are ordered by a hash of
    their texts.
    """
    w = Window.partitionBy("_block").orderBy("_peek", "_k", F.xxhash64("text"), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, ident).withColumn("_next", F.lead("text").over(w)).withColumn("_seq", F.row_number().over(w))
    edited = F.when(~F.col("_peek"), F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half)))
    rows = rows.select(ident, "_block", "_seq", "_peek", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    kind = dict(rows.dtypes)[ident]

    def run(batches):
        held = None  # the last document, until its next one is seen

        def out(b, own, changed, nxt):
            ok = ~np.asarray(b.column("_peek").to_pylist(), bool)
            take = pa.array(np.flatnonzero(ok))
            cols = [b.column(c).take(take) for c in (ident, "n_chars", "edited_sha256")]
            own, changed, nxt = (tuple(x[ok] for x in d) for d in (own, changed, nxt))
            cols += [pa.array(to_hex(*own), pa.string()), pa.array(to_hex(*changed), pa.string())]
            cols += [pa.array(likeness(own, changed)), pa.array(likeness(own, nxt))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id" if c == ident else c for c in (ident, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")])

        for b in batches:
            if not b.num_rows:
                continue
            own, changed = digests(b.column("text")), digests(b.column("edited"))
            block, seq = (np.asarray(b.column(c)) for c in ("_block", "_seq"))
            if (seq[1:] != np.where(block[1:] == block[:-1], seq[:-1] + 1, 1)).any():
                raise RuntimeError("rows are not in the order of their blocks")
            if held is not None:
                yield out(held[0], held[1], held[2], tuple(x[:1] for x in own))
            if b.num_rows > 1:
                cut = lambda d, lo, hi: tuple(x[lo:hi] for x in d)
                yield out(b.slice(0, b.num_rows - 1), cut(own, 0, -1), cut(changed, 0, -1), cut(own, 1, None))
            held = (b.slice(b.num_rows - 1), tuple(x[-1:] for x in own), tuple(x[-1:] for x in changed))
        if held is not None:  # a block ends with a peek row, which gives nothing
            yield out(held[0], held[1], held[2], held[1])

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
