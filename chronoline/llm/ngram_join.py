"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal words are one *text*. Texts become sets of five-word shingles and MinHash
values. Candidate pairs share one of ``BANDS`` bands of ``ROWS`` values; a pair at the threshold
is missed by all bands with a chance of (1 - 0.8**6)**40, five in a million. A candidate's values
are then compared a few at a time: with a uniform prior, the chance that its similarity reaches
the threshold, given the agreements so far, is a binomial tail, and the pair is dropped as soon
as it falls below ``TOLERANCE``. What is left is verified exactly on the shingle sets.

A band that few texts share gives its pairs as rows. One that many share (``SMALL``) only joins
its texts into a candidate group. Groups are compared in blocks of ``BLOCK`` texts: a task gets
two blocks and gives, for each text, the number of its links and one root of the texts it is
joined with. So rows grow with the texts, never with their pairs, no link is lost, and no task
holds more than two blocks. The work within one group of near copies is quadratic in the number of
*different* texts, in numpy, spread over tasks.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoline.llm import shingles as S
from chronoline.llm.common import lean, parts
from chronoline.llm.components import components
from chronoline.session import settle

THRESHOLD = 0.8
BANDS, ROWS = 40, 6
#: Values compared between two looks at the posterior, and where it drops a pair.
STEP, TOLERANCE = 24, 1e-7
#: Bytes of text whose shingles are hashed together: numpy needs some forty bytes for each.
SLICE = 1 << 19
#: The most texts of a band whose pairs are rows; texts of a block.
SMALL, BLOCK = 24, 256


def least_agreements(threshold: float = THRESHOLD, step: int = STEP, hashes: int = BANDS * ROWS, tolerance: float = TOLERANCE) -> list[int]:
    """For 1, 2, .. steps: the fewest agreements that keep a pair.

    With a uniform prior the similarity's posterior after m agreements of n is Beta(m+1, n-m+1),
    and the chance that it reaches t is that a binomial (n+1, t) is at most m.
    """
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def prune(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, cuts: list[int], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) that no look at the posterior drops."""
    agreed = np.zeros(len(i), np.int32)
    for k, cut in enumerate(cuts):
        cols = slice(k * step, (k + 1) * step)
        agreed += (left[i, cols] == right[j, cols]).sum(axis=1, dtype=np.int32)
        keep = agreed >= cut
        i, j, agreed = i[keep], j[keep], agreed[keep]
        if not len(i):
            break
    return i, j


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the named pairs of sorted sets, exactly."""
    used = np.unique(np.concatenate([i, j]))
    slot = {int(u): k for k, u in enumerate(used)}
    flat = np.concatenate([sets[u] for u in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)
    renumber = np.full(len(count), -1)
    renumber[common] = np.arange(len(common))
    column = renumber[column]
    owner, column = owner[column >= 0], column[column >= 0]
    a, b = np.array([slot[int(x)] for x in i]), np.array([slot[int(x)] for x in j])
    out = np.zeros(len(i), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, len(common), 2048):  # bounds the dense part
        left, right = np.searchsorted(column, [lo, lo + 2048])
        dense = np.zeros((len(used), 2048), np.float32)
        dense[owner[left:right], column[left:right] - lo] = 1
        if len(i) * 4 > len(used) ** 2:
            out += (dense @ dense.T)[a, b].astype(np.int64)
        else:
            for p in range(0, len(i), 4096):
                out[p : p + 4096] += np.einsum("ij,ij->i", dense[a[p : p + 4096]], dense[b[p : p + 4096]]).astype(np.int64)
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    up = np.arange(n)
    for a, b in zip(i.tolist(), j.tolist()):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        up[max(a, b)] = min(a, b)
    for a in range(n):
        up[a] = up[up[a]]
    return up


def _links(nodes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], values: np.ndarray, threshold: Fraction, cuts: list[int]) -> pd.DataFrame:
    """Links among texts of one group: within one block, or between two (sides 0 and 1)."""
    n = len(nodes)
    if (sides == 0).all() or (sides == 1).all():
        i, j = np.triu_indices(n, 1)
    else:
        i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(sides == 0), np.flatnonzero(sides == 1), indexing="ij"))
    i, j = prune(values, values, i, j, cuts)
    if len(i):
        size = np.array([len(s) for s in sets], np.int64)
        both = shared(sets, i, j)
        keep = both * threshold.denominator >= threshold.numerator * (size[i] + size[j] - both)
        keep &= both > 0
        i, j = i[keep], j[keep]
    links = np.bincount(np.concatenate([i, j]).astype(np.int64), minlength=n)
    return pd.DataFrame({"node": nodes, "root": nodes[_roots(n, i, j)], "links": links})[links > 0]


def similar_texts(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, width: int = S.WIDTH) -> DataFrame:
    """(node, root, links) of every text that has a link to a different text.

    ``node`` is :func:`shingles.words_key` of the text; root is the smallest node of its group of
    joined texts; links counts the different texts whose shingle sets have at least the
    threshold's Jaccard similarity with its own.
    """
    hashes = BANDS * ROWS
    cuts, exact = least_agreements(threshold, STEP, hashes), Fraction(str(threshold))
    keyed = docs.select(S.words_key(F.col(text)).alias("node"), F.coalesce(text, F.lit("")).alias("text"))

    def values(batches):
        for b in lean(batches):
            out = []
            for first, last, raw, at in S.slices(b.column("text"), SLICE):
                found, ends = S.shingle_hashes(raw, at, width)
                sig = S.minhash(found, ends, hashes)
                out += [sig[k].tobytes() if ends[k + 1] > ends[k] else None for k in range(last - first)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.binary())], ["node", "sig"])

    # one row per different text: copies meet before and after the shuffle, texts don't travel
    reps = keyed.mapInArrow(values, "node long, sig binary").where(F.col("sig").isNotNull())
    reps = settle(reps.groupBy("node").agg(F.first("sig").alias("sig")))

    salt = np.uint64(0x9E3779B97F4A7C15)

    def bands(batches):
        for b in lean(batches):
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(b.num_rows, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (b.num_rows, BANDS)).copy()
            for r in range(ROWS):
                key = S._mix(key * salt + sig[:, :, r] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("node")), BANDS)), pa.array(key.ravel().view(np.int64))], ["node", "band"])

    banded = reps.mapInArrow(bands, "node long, band long")
    sizes = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    banded = settle(banded.join(sizes, "band"))

    # small bands: pairs as rows, pruned by their values
    listed = banded.where(F.col("n") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("node")).alias("x"))  # at most SMALL each
    paired = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.lit(SMALL)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = listed.select(F.explode(paired).alias("p")).select("p.a", "p.b").distinct()
    pairs = pairs.join(reps.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    pairs = pairs.join(reps.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def likely(batches):
        for b in lean(batches):
            left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, hashes) for c in ("sa", "sb"))
            at = np.arange(b.num_rows)
            kept, _ = prune(left, right, at, at, cuts)
            take = pa.array(kept)
            yield pa.RecordBatch.from_arrays([b.column("a").take(take), b.column("b").take(take)], ["a", "b"])

    pairs = pairs.mapInArrow(likely, "a long, b long")
    # large bands: their texts join one candidate group
    stars = banded.where((F.col("n") > SMALL) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = settle(components(pairs.union(stars)))

    # blocks of a group; small groups share tasks
    count = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    packs = parts(groups, BLOCK, most=1_000_000)
    placed = groups.join(count, "root").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "node", "root", "blocks", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    placed = placed.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root", F.lit(5)), F.lit(packs))).otherwise(F.xxhash64("root", "lo", "hi")))
    texts = keyed.groupBy("node").agg(F.first("text").alias("text"))
    work = placed.join(texts, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets: list[np.ndarray] = []
        sigs = []
        for first, last, raw, at in S.slices(pa.array(pdf["text"], pa.large_string()), SLICE):
            found, ends = S.shingle_hashes(raw, at, width)
            sigs.append(S.minhash(found, ends, hashes))
            sets += [np.unique(found[ends[k] : ends[k + 1]]) for k in range(last - first)]
        sig = np.concatenate(sigs)
        nodes, side, blocks = (pdf[c].to_numpy() for c in ("node", "side", "blocks"))
        out = []
        for (root, _, _), at in pdf.groupby(["root", "lo", "hi"]).indices.items():
            at = at[np.argsort(nodes[at])]
            links = _links(nodes[at], side[at], [sets[k] for k in at], sig[at], exact, cuts)
            out.append(links.assign(whole=blocks[at[0]] == 1))
        return pd.concat(out)

    found = settle(work.groupBy("task").applyInPandas(compare, "node long, root long, links long, whole boolean"))
    # a group of one block is final; roots of several blocks are joined once more
    joined = components(found.where(~F.col("whole")).select(F.col("node").alias("a"), F.col("root").alias("b")))
    several = found.where(~F.col("whole")).groupBy("node").agg(F.sum("links").alias("links")).join(joined, "node").select("node", "root", "links")
    return found.where("whole").select("node", "root", "links").union(several)


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = S.WIDTH) -> DataFrame:
    """(ident, class_id, n_links, n_copies): one row for each row of ``docs``.

    class_id is the smallest id of the documents that are joined with this one by equal words or
    by links; n_links counts the different texts linked to its own; n_copies the rows with its
    own words. Null and empty texts have no words: they are copies of each other, without links.
    Texts of fewer than ``width`` words have one shingle. Null ids are kept; a class of null ids
    alone has a null class_id. Repeated rows are copies. An empty table gives an empty result.
    """
    found = settle(similar_texts(docs, text, threshold, width))
    rows = settle(docs.select(ident, S.words_key(F.col(text)).alias("node")))
    texts = rows.groupBy("node").agg(F.min(ident).alias("least"), F.count("*").alias("n_copies"))
    texts = texts.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = texts.groupBy("root").agg(F.min("least").alias("class_id"))
    texts = texts.join(classes, "root").select("node", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    return rows.join(texts, "node").select(ident, "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = S.WIDTH) -> DataFrame:
    """The rows of ``docs`` but one of each group of near duplicates: that of the smallest id.

    All columns stay. Among rows of equal words and ids any one stays. Documents without words
    are copies of each other, so one of them stays.
    """
    found = settle(similar_texts(docs, text, threshold, width))
    # the row is packed, so its columns can't clash with those beside it
    key = F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"))
    named = docs.select(S.words_key(F.col(text)).alias("_node"), key.alias("_key"), F.struct(*docs.columns).alias("_row"))
    least = named.groupBy("_node").agg(F.min("_key").alias("_least")).join(found, F.col("_node") == F.col("node"))
    first = least.groupBy("root").agg(F.min(F.struct("_least", "node")).alias("w"))
    gone = least.join(first, "root").where(F.col("node") != F.col("w.node")).select(F.col("node").alias("_node"))
    kept = named.groupBy("_node").agg(F.min_by("_row", "_key").alias("_row")).join(gone, "_node", "left_anti")
    return kept.select("_row.*")
