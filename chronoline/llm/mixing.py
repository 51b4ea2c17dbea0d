"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in one permuted stream (by a keyed md5 of the id), its *epoch*. A
source with a target of T words gives the first T words of its stream, read round after round:
whole epochs and the beginning of one more. Those words are cut into blocks, the source's exact
quota. The tree halves the output shards again and again; at each node the left half's share of
every source's blocks is drawn from the multivariate hypergeometric distribution, so that quotas
stay exact, shards are equally long, and the sources' proportions vary as in a true shuffle. A
shard reads its own disjoint range of blocks of each permuted stream and orders them by a local
hash. The tree works on quotas alone (sources x shards numbers, checked); documents never pass
the driver.

Offsets in the streams are prefix sums over hash prefixes, three hex digits a level, so no window
holds more than about 4096 summary rows or ``LEAF_ROWS`` documents, however large a source is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoline.llm.common import WORD

#: Bounds of what the driver and broadcasts hold.
MAX_SOURCES, MAX_CELLS = 100_000, 8_000_000
#: Documents in one leaf window, about.
LEAF_ROWS = 1500
#: Output shards.
SHARDS = 64
#: Weights by the sources' order, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], factor: float, most: int) -> list[float]:
    """Shares of ``factor`` times all words by weight, none above ``most`` times its own size.

    What a source can't take is shared again by weight. The sources that stop at their limit are
    those of the smallest limit per weight; the rest take one common amount per weight.
    """
    caps = [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    total, capped, left = factor * sum(sizes), 0, sum(weights)
    out = [float(c) for c in caps]
    for k, i in enumerate(order):
        unit = (total - capped) / left
        if caps[i] / weights[i] >= unit:
            for j in order[k:]:
                out[j] = unit * weights[j]
            break
        capped, left = capped + caps[i], left - weights[i]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(sources, shards) blocks that each shard takes of each source; rows sum to the quotas.

    Shards get equal totals but for one block. Each node draws from a generator of its own, keyed
    by the seed and the node, so reruns agree.
    """
    if len(quotas) * shards > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} source and shard cells")
    out = np.zeros((len(quotas), shards), np.int64)
    stack = [(0, shards, np.asarray(quotas, np.int64))]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            out[:, lo] = have
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        total = int(have.sum())
        draw = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, draw, method="marginals") if draw else np.zeros_like(have)
        stack += [(lo, mid, left), (mid, hi, have - left)]
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = 1.5, most: int = 2, shards: int = SHARDS, seed: int = 7, ident: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target, taken and pieces.

    ``docs`` has the id, ``text`` or a ``size`` column, and ``source``; sources are ordered by code
    point, null last, and weigh ``weights`` in turn. ``pieces`` lists (copy, words, shard): one
    entry for each time the mix reads the document; all but a source's last read are whole.

    Null and empty texts have no words and are never taken. Null ids share one place in the
    permutation and are then ordered by size. Repeated rows are documents of their own. An empty
    table gives an empty result. Columns with clashing names are replaced.
    """
    spark = docs.sparkSession
    new = ["source_size", "target", "taken", "pieces"]
    docs = docs.drop(*(c for c in docs.columns if c in new or c.startswith("_mix_")))
    if "size" not in docs.columns:
        docs = docs.withColumn("size", word_count(F.col("text")))
    keep = docs.columns
    docs = docs.withColumn("_mix_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    docs = docs.withColumn("_mix_k", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit(""))).cast("binary")))

    levels, reach = 0, LEAF_ROWS
    rows = docs.count()
    while reach < rows:
        levels, reach = levels + 1, reach * 4096
    digits = 3 * levels
    if levels == 1:  # as many digits as needed
        digits = next(d for d in (1, 2, 3) if LEAF_ROWS * 16**d >= rows)
    docs = docs.withColumn("_mix_p", F.substring("_mix_k", 1, digits))

    sums = docs.groupBy("_mix_s", "_mix_p").agg(F.sum("size").alias("_mix_n"))
    found = sums.groupBy("_mix_s").agg(F.sum("_mix_n").alias("n")).limit(MAX_SOURCES + 1).collect()  # one row a source, checked
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(((r["_mix_s"], int(r["n"])) for r in found), key=lambda x: (x[0] == "n", x[0]))
    sizes = [n for _, n in found]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], factor, most)
    words = [int(np.floor(t + 0.5)) for t in want]
    width = max(1, -(-sum(words) // (shards * 256)))
    quotas = split_quotas([-(-w // width) for w in words], shards, seed)
    ends = np.cumsum(quotas, axis=1)
    listed = spark.createDataFrame(
        [(s, n, t, w, [int(x) for x in e]) for (s, n), t, w, e in zip(found, want, words, ends)],
        "_mix_s string, source_size long, target double, _mix_t long, _mix_e array<long>",
    )

    # offsets of the prefixes, level by level: each window sees one parent's children
    offsets = None
    for upto in [*range(3, digits, 3), digits] if digits else [0]:
        parent = max(0, (upto - 1) // 3 * 3)
        here = sums.groupBy("_mix_s", F.substring("_mix_p", 1, upto).alias("_mix_p")).agg(F.sum("_mix_n").alias("_mix_n"))
        here = here.withColumn("_mix_up", F.substring("_mix_p", 1, parent))
        w = Window.partitionBy("_mix_s", "_mix_up").orderBy("_mix_p").rowsBetween(Window.unboundedPreceding, -1)
        here = here.withColumn("_mix_o", F.coalesce(F.sum("_mix_n").over(w), F.lit(0)))
        if offsets is not None:
            above = offsets.select("_mix_s", F.col("_mix_p").alias("_mix_up"), F.col("_mix_o").alias("_mix_a"))
            here = here.join(above, ["_mix_s", "_mix_up"]).withColumn("_mix_o", F.col("_mix_o") + F.col("_mix_a"))
        offsets = here.select("_mix_s", "_mix_p", "_mix_o")

    w = Window.partitionBy("_mix_s", "_mix_p").orderBy("_mix_k", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        docs.join(offsets, ["_mix_s", "_mix_p"])
        .withColumn("_mix_c", F.col("_mix_o") + F.coalesce(F.sum("size").over(w), F.lit(0)))
        .join(F.broadcast(listed), "_mix_s")  # at most MAX_CELLS numbers, checked
    )
    start = lambda copy: F.col("_mix_c") + copy * F.col("source_size")
    took = lambda copy: F.greatest(F.lit(0), F.least(F.col("size"), F.col("_mix_t") - start(copy))).cast("long")
    shard = lambda copy: F.array_size(F.filter("_mix_e", lambda e: e <= F.floor(start(copy) / width))).cast("int")
    pieces = F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), lambda i: took(i) > 0),
        lambda i: F.struct(i.cast("int").alias("copy"), took(i).alias("words"), shard(i).alias("shard")),
    )
    return placed.withColumn("pieces", pieces).select(
        *keep, "source_size", "target", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"), "pieces",
    )


def deal(mixed: DataFrame, seed: int = 7, ident: str = "doc_id") -> DataFrame:
    """One row per piece of a mix with its copy, words, shard and a local order within the shard."""
    return (
        mixed.drop("copy", "words", "shard", "shard_order")
        .withColumn("_piece", F.explode("pieces"))
        .withColumns({c: F.col(f"_piece.{c}") for c in ("copy", "words", "shard")})
        .withColumn("shard_order", F.xxhash64(F.lit(seed), "shard", F.col(ident), "copy"))
        .drop("_piece", "pieces")
    )


def mixed_texts(mixed: DataFrame, seed: int = 7, ident: str = "doc_id") -> DataFrame:
    """The pieces of ``deal`` with their texts.

    A whole read keeps the text as it is; the one that a source's target cuts short ends after
    its last taken word.
    """
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")
    return deal(mixed, seed, ident).withColumn("text", F.when(F.col("words") < F.col("size"), head).otherwise(F.col("text")))


def in_shards(dealt: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows with one partition for each shard, in the shard's local order."""
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard_order")
