"""Approximate nearest neighbours by cosine with robust-pruned directed graphs.

Equal vectors are one node that carries its smallest ids, so a vector that fills a third of the
table is one node. Nodes are dealt by hash into shards of about ``SHARD`` nodes; each shard gets a
directed graph: greedy beam searches from a start node propose neighbours for every node, and
robust pruning keeps the near ones unless a kept one is nearer to them by the factor ``ALPHA``;
kept edges are also offered backwards, and full lists are pruned again. A second round over all
nodes mends what the first one searched on an unfinished graph.

The index is a table with one row for each shard. A search pairs shards with packed blocks of at
most about ``QUERY_BLOCK`` queries, ``TOGETHER`` blocks or so for each copy of a shard, and merges each
query's best. All searches of a block advance together in numpy; scores are recomputed in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoline.session import settle

SHARD, QUERY_BLOCK = 4096, 1024
DEGREE, BEAM, SEARCH_BEAM, ALPHA = 32, 64, 192, 1.2
#: Nodes expanded at once in a step of a search; searches that advance together.
WIDE, BATCH = 4, 256
#: Query blocks that one copy of a shard serves; tasks of a search, at most.
TOGETHER, MOST_TASKS = 8, 10_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the square
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances), each (queries, beam), nearest first; -1 fills what was not reached.

    ``graph`` has -1 for no edge. Distances are squared, of unit vectors.
    """
    n, m = len(x), len(queries)
    row = np.arange(m)[:, None]
    ids = np.full((m, beam), -1, np.int32)
    dist = np.full((m, beam), np.inf, np.float32)
    seen = np.zeros((m, n + 1), bool)  # the last column takes -1
    first = starts[:beam]
    ids[:, : len(first)] = first
    dist[:, : len(first)] = 2 - 2 * queries @ x[first].T
    seen[:, first] = True
    done = np.zeros((m, beam), bool)
    while True:
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist, done = ids[row, order], dist[row, order], done[row, order]
        live = ~done & (ids >= 0)
        active = np.flatnonzero(live.any(axis=1))
        if not len(active):
            return ids, dist
        at = np.arange(len(active))[:, None]
        # the first WIDE nodes not yet expanded
        pick = np.argsort(~live[active], axis=1, kind="stable")[:, :WIDE]
        real = live[active][at, pick]
        done[active[:, None], pick] = True
        near = np.where(real[:, :, None], graph[ids[active][at, pick]], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[active[:, None], near]] = -1
        seen[active[:, None], near] = True
        seen[:, n] = False
        d = 2 - 2 * np.einsum("md,mkd->mk", queries[active], x[near])
        d[near < 0] = np.inf
        all_ids, all_d = np.concatenate([ids[active], near], axis=1), np.concatenate([dist[active], d], axis=1)
        all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        ids[active], dist[active], done[active] = all_ids[at, best], all_d[at, best], all_done[at, best]
        ids[active] = np.where(np.isinf(dist[active]), -1, ids[active])


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """(nodes, degree) kept neighbours out of candidates (nodes, k); -1 fills."""
    row = np.arange(len(nodes))[:, None]
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == nodes[:, None]] = -1
    own = 2 - 2 * np.einsum("md,mkd->mk", x[nodes], x[cand])
    own[cand < 0] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    cand, own = cand[row, order], own[row, order]
    vectors, alive = x[cand], cand >= 0
    out = np.full((len(nodes), degree), -1, np.int32)
    for k in range(degree):
        if not alive.any():
            break
        some = alive.any(axis=1)
        pick = alive.argmax(axis=1)
        chosen = cand[row[:, 0], pick]
        out[some, k] = chosen[some]
        between = 2 - 2 * np.einsum("md,mkd->mk", x[chosen], vectors)
        alive &= ~((alpha * alpha * between <= own) & some[:, None])
        alive[row[:, 0], pick] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(graph, start nodes) of one shard."""
    x, n, rng = _unit(vectors), len(vectors), np.random.default_rng(seed)
    middle = int((x @ x.mean(axis=0)).argmax())
    starts = np.unique(np.concatenate([[middle], rng.permutation(n)[:7]])).astype(np.int32)
    if n <= degree + 1:
        return np.array([[j for j in range(n) if j != i] + [-1] * (degree + 1 - n) for i in range(n)], np.int32).reshape(n, degree), starts
    graph = rng.integers(0, n, (n, degree), dtype=np.int32)
    for factor in (1.0, alpha):
        order = rng.permutation(n).astype(np.int32)
        for lo in range(0, n, BATCH):
            nodes = order[lo : lo + BATCH]
            found, _ = beam_search(x, graph, starts, x[nodes], beam)
            graph[nodes] = robust_prune(x, nodes, np.concatenate([found, graph[nodes]], axis=1), factor, degree)
            # offer the edges backwards; lists that get too long are pruned
            a, b = np.repeat(nodes, degree), graph[nodes].ravel()
            a, b = a[b >= 0], b[b >= 0]
            by = np.argsort(b, kind="stable")
            a, b = a[by], b[by]
            ends, first, count = np.unique(b, return_index=True, return_counts=True)
            offered = np.full((len(ends), int(count.max())), -1, np.int32)
            offered[np.repeat(np.arange(len(ends)), count), np.arange(len(b)) - np.repeat(first, count)] = a
            both = np.concatenate([graph[ends], offered], axis=1)
            for k in range(0, len(ends), 4 * BATCH):
                part = slice(k, k + 4 * BATCH)
                graph[ends[part]] = robust_prune(x, ends[part].astype(np.int32), both[part], factor, degree)
    return graph, starts


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, not zero, no null, NaN or infinite part."""
    bad = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def build_index(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """One row for each shard: dim, shard, n and binary vectors, ids, graph and starts.

    Each node has the ``k + 1`` smallest ids of its vector, enough for any query, its own row
    aside. Rows with a null id or an unusable vector take no part.
    """
    kept = rows.where(F.col(ident).isNotNull() & usable(F.col(vector))).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    few = Window.partitionBy("v").orderBy("id")
    # the limit on the rank is applied before the shuffle too, so copies don't travel
    kept = kept.distinct().withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    nodes = settle(kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    shards = max(1, -(-nodes.count() // SHARD))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        ids = np.full((len(v), k + 1), -1, np.int64)
        for i, x in enumerate(pdf["ids"]):
            ids[i, : len(x)] = x
        count = pdf["ids"].map(len).to_numpy().astype(np.int32)
        graph, starts = build_graph(v)
        return pd.DataFrame([{
            "dim": v.shape[1], "shard": int(pdf["shard"].iloc[0]), "n": len(v), "vectors": v.tobytes(), "ids": ids.tobytes(), "counts": count.tobytes(), "graph": graph.tobytes(), "starts": starts.tobytes(),
        }])

    return settle(nodes.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard int, n int, vectors binary, ids binary, counts binary, graph binary, starts binary",
    ))


def search(index: DataFrame, queries: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, its own id aside.

    Score is the cosine in double precision on the original vectors; ties go to the smaller id.
    Fewer candidates give fewer rows; queries with a null id or an unusable vector give none.
    Candidates of another length take no part. Repeated query rows are answered once.
    """
    asked = queries.where(F.col(ident).isNotNull() & usable(F.col(vector))).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    asked = asked.withColumn("dim", F.size("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{
            "dim": int(pdf["dim"].iloc[0]), "block": int(pdf["block"].iloc[0]), "asked": pdf["id"].to_numpy(np.int64).tobytes(), "q": np.stack(pdf["v"].to_numpy()).astype(np.float64).tobytes(),
        }])

    packed = asked.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, asked binary, q binary")
    # each block goes to every shard by its number, so no task meets all shards or all blocks; a shard is
    # copied for some blocks together, not for each. Neither side is broadcast: Spark takes the packed
    # blocks for a few bytes, and through the driver they would go times the shards
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    copies = -(-blocks // TOGETHER)
    tasks = max(1, min(MOST_TASKS, shards * copies))
    sent = packed.select("dim", "block", "asked", "q", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("at"))
    sent = sent.withColumn("shard", F.col("at") * copies + F.col("block") % copies).drop("at").repartition(tasks, "dim", "shard")
    held = index.withColumn("shard", F.explode(F.sequence(F.col("shard") * copies, F.col("shard") * copies + copies - 1))).repartition(tasks, "dim", "shard")
    pairs = sent.join(held.hint("merge"), ["dim", "shard"])

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                v = np.frombuffer(r.vectors).reshape(r.n, r.dim)
                ids, counts = np.frombuffer(r.ids, np.int64).reshape(r.n, k + 1), np.frombuffer(r.counts, np.int32)
                graph, starts = np.frombuffer(r.graph, np.int32).reshape(r.n, -1), np.frombuffer(r.starts, np.int32)
                own, q = np.frombuffer(r.asked, np.int64), np.frombuffer(r.q).reshape(-1, r.dim)
                x, unit = _unit(v), _unit(q)
                for lo in range(0, len(q), BATCH):
                    part = slice(lo, lo + BATCH)
                    found, _ = beam_search(x, graph, starts, unit[part], min(SEARCH_BEAM, max(8, r.n)))
                    a, b = np.nonzero(found >= 0)
                    node = found[a, b]
                    left, right = q[part][a], v[node]
                    score = (left * right).sum(axis=1) / (np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1)))
                    many = counts[node]
                    out = pd.DataFrame({"query_id": np.repeat(own[part][a], many), "vec_id": ids[node][np.arange(k + 1) < many[:, None]], "score": np.repeat(score, many)})
                    out = out[out.query_id != out.vec_id].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                    yield out.groupby("query_id").head(k)

    best = pairs.mapInPandas(run, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
