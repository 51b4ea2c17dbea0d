"""Gradient-boosted trees for all classes at once, on binned features.

The trees are grown level by level on histograms: every row's features are binned once, and a level
adds up gradients and Hessians of the softmax loss by (node, feature, bin) for each class. All labelled
rows are fitted: few in one task, more in blocks of rows whose histograms are added up level by level;
no task holds all rows and the driver sees sums only. Scoring is spread over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from chronoline.session import scratch_path, settle

#: Labelled rows that one task fits, at most; more are fitted in blocks, one for each core, of ``LEAST_ROWS`` to ``BLOCK_ROWS`` or so.
TASK_ROWS, LEAST_ROWS, BLOCK_ROWS = 20_000, 4096, 200_000
#: Rounds after which the rows' state is written; blocks whose sums go to the driver without a sum in between.
WRITE_EVERY, DIRECT = 20, 16
#: Bins of a feature, L2 penalty of a leaf, least Hessian sum of a leaf.
BINS, PENALTY, LEAST_WEIGHT = 256, 1.0, 1.0


@dataclass
class Trees:
    """Trees as heaps: node k has the children 2k + 1 and 2k + 2; feature -1 marks a leaf."""

    classes: np.ndarray  # the labels seen, one column of trees for each
    feature: np.ndarray  # (rounds, classes, nodes)
    cut: np.ndarray  # up to the cut goes left, and so do missing values
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes seen) sums of leaf values."""
        rounds, many, nodes = self.feature.shape
        feature, cut, value = self.feature.reshape(-1, nodes), self.cut.reshape(-1, nodes), self.value.reshape(-1, nodes)
        tree, out = np.arange(rounds * many)[None, :], np.zeros((len(x), many))
        step = max(1, 4_000_000 // max(1, rounds * many))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            node, row = np.zeros((len(part), rounds * many), np.int64), np.arange(len(part))[:, None]
            for _ in range((nodes + 1).bit_length() - 2):
                f = feature[tree, node]
                right = part[row, f] > cut[tree, node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            out[lo : lo + step] = value[tree, node].reshape(len(part), rounds, many).sum(axis=1)
        return out

    def probabilities(self, x: np.ndarray, n_classes: int) -> np.ndarray:
        """Softmax over the classes seen; the others get 0."""
        out = np.zeros((len(x), n_classes))
        out[:, self.classes] = softmax(self.margins(x))
        return out


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _binned(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers, and each feature's cuts: at most ``bins`` - 1 values between its quantiles."""
    cuts, out = [], np.zeros(x.shape, np.int64)
    for f in range(x.shape[1]):
        seen = np.unique(x[:, f][np.isfinite(x[:, f])])
        if len(seen) > bins:
            seen = np.unique(np.quantile(x[:, f][np.isfinite(x[:, f])], np.linspace(0, 1, bins)))
        cuts.append((seen[1:] + seen[:-1]) / 2)
        out[:, f] = np.searchsorted(cuts[f], np.where(np.isnan(x[:, f]), -np.inf, x[:, f]), side="left")
    return out, cuts


def _best_splits(left_g: np.ndarray, left_h: np.ndarray, all_g: np.ndarray, all_h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's best (feature, bin), as one number, and its gain, from running sums (nodes, features, bins)."""
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - all_g**2 / (all_h + PENALTY)
    gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = -np.inf
    gain = gain.reshape(len(gain), -1)
    best = gain.argmax(axis=1)
    return best, gain[np.arange(len(gain)), best]


def grow(binned: np.ndarray, bins: int, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree: (feature, bin, value) of its nodes and the leaf of every row."""
    n, many = binned.shape
    nodes = 2 ** (depth + 1) - 1
    feature, at, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
    node = np.zeros(n, np.int64)
    place = binned + np.arange(many) * bins
    live = np.arange(n)
    for level in range(depth + 1):
        first, width = 2**level - 1, 2**level
        own = node[live] - first
        total_g, total_h = np.bincount(own, g[live], width), np.bincount(own, h[live], width)
        value[first : first + width] = -rate * total_g / (total_h + PENALTY)
        # only nodes heavy enough for two leaves are looked at, and only their rows
        heavy = np.flatnonzero(total_h >= 2 * LEAST_WEIGHT)
        if level == depth or not len(heavy):
            break
        slot = np.full(width, -1)
        slot[heavy] = np.arange(len(heavy))
        live = live[slot[own] >= 0]
        cell = (slot[node[live] - first][:, None] * (many * bins) + place[live]).ravel()
        left_g, left_h = (np.bincount(cell, np.repeat(v[live], many), len(heavy) * many * bins).reshape(-1, many, bins).cumsum(axis=2) for v in (g, h))
        all_g, all_h = total_g[heavy][:, None, None], total_h[heavy][:, None, None]
        best, top = _best_splits(left_g, left_h, all_g, all_h)
        split = np.flatnonzero(top > 1e-12)
        if not len(split):
            break
        feature[first + heavy[split]], at[first + heavy[split]] = best[split] // bins, best[split] % bins
        live = live[feature[node[live]] >= 0]
        here = node[live]
        node[live] = 2 * here + 1 + (binned[live, feature[here]] > at[here])
    return feature, at, value, node


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, depth: int, rate: float, bins: int = BINS) -> Trees:
    """Softmax boosting: each round grows one tree for every class seen, on the same margins."""
    classes, own = np.unique(y, return_inverse=True)
    binned, cuts = _binned(x, bins)
    bins = max([len(c) + 1 for c in cuts], default=1)
    nodes, many = 2 ** (depth + 1) - 1, len(classes)
    feature, at, value = np.full((rounds, many, nodes), -1), np.zeros((rounds, many, nodes), np.int64), np.zeros((rounds, many, nodes))
    margin, hit = np.zeros((len(x), many)), np.eye(many)[own]
    for r in range(rounds if many > 1 else 0):
        p = softmax(margin)
        g, h = (p - hit) * weight[:, None], np.maximum(2 * p * (1 - p), 1e-16) * weight[:, None]
        for c in range(many):
            feature[r, c], at[r, c], value[r, c], leaf = grow(binned, bins, g[:, c], h[:, c], depth, rate)
            margin[:, c] += value[r, c][leaf]
    wide = np.zeros((x.shape[1], bins))
    for f, c in enumerate(cuts):
        wide[f, : len(c)] = c
    return Trees(classes, feature, np.where(feature >= 0, wide[feature, at], 0.0), value)


def _cuts(rows: DataFrame, names: Sequence[str], n: int, bins: int) -> list[np.ndarray]:
    """Each feature's cuts as ``_binned`` has them, from exact quantiles of all rows: values are counted and ranged, so no task holds a feature."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(c).alias("v")) for k, c in enumerate(names)))).alias("s")
    long = rows.select(pairs).select("s.f", "s.v").where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    parts = max(1, -(-n * len(names) // 250_000))
    ranged = settle(long.groupBy("f", "v").agg(F.count("*").alias("c")).repartitionByRange(parts, "f", "v").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("f", "part").agg(F.sum("c").alias("n"), F.count("*").alias("d")).orderBy("f", "part").collect()
    asked, place = {}, {}
    for f in range(len(names)):
        mine = [r for r in sums if r["f"] == f]
        total = sum(r["n"] for r in mine)
        if sum(r["d"] for r in mine) > bins:
            at = np.linspace(0, 1, bins) * (total - 1)
            place[f] = at
            ranks = np.unique(np.concatenate([np.floor(at), np.ceil(at)])).astype(np.int64)
        else:
            ranks = None  # few values: all of them
        done = 0
        for r in mine:
            asked[f, r["part"]] = (done, None if ranks is None else ranks[(ranks >= done) & (ranks < done + r["n"])])
            done += r["n"]

    def pick(key, pdf: pd.DataFrame) -> pd.DataFrame:
        done, ranks = asked[int(key[0]), int(key[1])]
        pdf = pdf.sort_values("v")
        upto = pdf["c"].to_numpy().cumsum()
        ranks = done + upto - 1 if ranks is None else ranks
        return pd.DataFrame({"f": np.full(len(ranks), key[0], np.int32), "rank": ranks, "v": pdf["v"].to_numpy()[np.searchsorted(upto, ranks - done, side="right")]})

    found = ranged.groupBy("f", "part").applyInPandas(pick, "f int, rank long, v double").toPandas()  # two values for each bin at most
    cuts = []
    for f in range(len(names)):
        mine = found[found["f"] == f].sort_values("rank")
        seen = mine["v"].to_numpy()
        if f in place:
            at, ranks = place[f], mine["rank"].to_numpy()
            low, high, t = seen[np.searchsorted(ranks, np.floor(at))], seen[np.searchsorted(ranks, np.ceil(at))], at - np.floor(at)
            seen = np.unique(np.where(t < 0.5, low + (high - low) * t, high - (high - low) * (1 - t)))
        cuts.append((seen[1:] + seen[:-1]) / 2)
    return cuts


def _leaves(feature: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The node that each row, a column of ``codes``, has come to in a tree, which may still grow."""
    n = codes.shape[1]
    node, row, flat = np.zeros(n, np.int64), np.arange(n), codes.ravel()
    for _ in range(int(np.flatnonzero(feature >= 0).max(initial=-1) + 1).bit_length()):
        f = feature.take(node)
        right = flat.take(f * n + row, mode="wrap") > at.take(node)  # a leaf's place does not count
        node = np.where(f < 0, node, 2 * node + 1 + right)
    return node


def _added(blocks: RDD, asked: list[np.ndarray], feature: np.ndarray, at: np.ndarray, bins: int, scale: float) -> np.ndarray:
    """(2, nodes asked, features, bins): whole numbers whose float sums are exact, so their order does not matter.

    ``asked`` has each class's nodes by number; what is added up is bounded by the trees, not by the rows.
    """
    def sums(states):
        for codes, own, weight, margin in states:
            many = len(codes)
            p, out = softmax(margin), []
            for c, nodes in enumerate(asked):
                if not len(nodes):
                    continue
                slot = np.full(feature.shape[1], -1)
                slot[nodes] = np.arange(len(nodes))
                mine = slot[_leaves(feature[c], at[c], codes)]
                live = np.flatnonzero(mine >= 0)
                q, first = p[live, c], mine[live] * bins
                both = (q - (own[live] == c)) * weight[live], np.maximum(2 * q * (1 - q), 1e-16) * weight[live]
                held = np.zeros((2, len(nodes), many, bins))
                for k, v in enumerate(np.rint(x * scale) for x in both):
                    for f in range(many):
                        held[k, :, f] = np.bincount(first + codes[f].take(live), v, len(nodes) * bins).reshape(-1, bins)
                out.append(held)
            yield np.concatenate(out, axis=1)

    parts = blocks.mapPartitions(sums)
    return parts.reduce(np.add) if parts.getNumPartitions() <= DIRECT else parts.treeReduce(np.add)


def fit_blocks(rows: DataFrame, many: int, n: int, rounds: int, depth: int, rate: float, bins: int = BINS) -> Trees:
    """``fit`` over all rows (x0, x1, ..., y, w) in blocks: the same trees but for the rounding of sums."""
    spark, names = rows.sparkSession, [f"x{k}" for k in range(many)]
    cuts = _cuts(rows, names, n, bins)
    bins = max([len(c) + 1 for c in cuts], default=1)
    classes = np.array(sorted(r["y"] for r in rows.select("y").distinct().collect()))
    # the sum's last digits hang on its order
    mean = float(f"{rows.agg(F.avg('w')).first()[0]:.12g}") or 1.0
    k, nodes = len(classes), 2 ** (depth + 1) - 1
    scale = 2.0 ** min(40, 51 - n.bit_length())
    feature, at, value = np.full((rounds, k, nodes), -1), np.zeros((rounds, k, nodes), np.int64), np.zeros((rounds, k, nodes))

    def pack(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            codes = np.zeros((b.num_rows, many), np.uint8)
            for f in range(many):
                v = b.column(f).to_numpy(zero_copy_only=False).astype(np.float64)
                codes[:, f] = np.searchsorted(cuts[f], np.where(np.isnan(v), -np.inf, v), side="left")
            own = np.searchsorted(classes, b.column(many).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes, own.astype(np.int64), b.column(many + 1).to_numpy() / mean)], ["codes", "own", "w"])

    def start(packed):
        held = [(np.frombuffer(r["codes"], np.uint8).reshape(-1, many), np.frombuffer(r["own"], np.int64), np.frombuffer(r["w"])) for r in packed]
        if held:
            codes, own, weight = (np.concatenate(x) for x in zip(*held))
            yield np.ascontiguousarray(codes.T), own, weight, np.zeros((len(own), k))
        else:
            yield np.zeros((many, 0), np.uint8), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, k))

    def moved(f, a, v):
        def step(states):
            for codes, own, weight, margin in states:
                yield codes, own, weight, margin + np.stack([v[c][_leaves(f[c], a[c], codes)] for c in range(k)], axis=1)
        return step

    parts = max(-(-n // BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    blocks = rows.repartition(parts).select(*names, "y", "w").mapInArrow(pack, "codes binary, own binary, w binary").rdd.mapPartitions(start)
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    for r in range(rounds if k > 1 else 0):
        if r and r % WRITE_EVERY == 0:  # a lost executor costs some rounds, and the plan stays short
            path = scratch_path(spark)
            blocks.saveAsPickleFile(path)
            old, blocks = blocks, spark.sparkContext.pickleFile(path, 1).persist(StorageLevel.MEMORY_AND_DISK)
            old.unpersist()
        f, a, v = feature[r], at[r], value[r]
        asked, held = [np.array([0])] * k, [{} for _ in range(k)]
        for level in range(depth):
            got, here = _added(blocks, asked, f, a, bins, scale) / scale, 0
            if before is not None:
                before.unpersist()
                before = None
            now: list[dict] = [{} for _ in range(k)]
            for c in range(k):
                for j, node in enumerate(asked[c]):
                    now[c][int(node)] = got[:, here + j]
                    if node and int(node) + (1 if node % 2 else -1) not in asked[c]:  # its sibling has the rest of their parent
                        now[c][int(node) + (1 if node % 2 else -1)] = held[c][(int(node) - 1) // 2] - got[:, here + j]
                here += len(asked[c])
            if level == 0:
                for c in range(k):
                    g, h = now[c][0][:, 0].sum(axis=1)
                    v[c, 0] = -rate * g / (h + PENALTY)
            asked, held = [], now
            for c in range(k):
                ask = []
                own = [i for i, s in now[c].items() if s[1, 0].sum() >= 2 * LEAST_WEIGHT]
                if own:
                    sums = np.stack([now[c][i] for i in own], axis=1).cumsum(axis=3)
                    total = sums[:, :, :1, -1:]
                    best, top = _best_splits(sums[0], sums[1], total[0], total[1])
                    for j, i in enumerate(own):
                        if top[j] <= 1e-12:
                            continue
                        f[c, i], a[c, i] = best[j] // bins, best[j] % bins
                        left = sums[:, j, f[c, i], a[c, i]]
                        sides = {2 * i + 1: left, 2 * i + 2: total[:, j, 0, 0] - left}
                        for child, (g, h) in sides.items():
                            v[c, child] = -rate * g / (h + PENALTY)
                        if level + 1 < depth and max(h for _, h in sides.values()) >= 2 * LEAST_WEIGHT:
                            ask.append(min(sides, key=lambda s: sides[s][1]))
                asked.append(np.array(ask, np.int64))
            if not any(len(x) for x in asked):
                break
        before = blocks
        blocks = blocks.mapPartitions(moved(f, a, v)).persist(StorageLevel.MEMORY_AND_DISK)
    for x in (before, blocks):
        if x is not None:
            x.unpersist()
    wide = np.zeros((many, bins))
    for j, c in enumerate(cuts):
        wide[j, : len(c)] = c
    return Trees(classes, feature, np.where(feature >= 0, wide[feature, at], 0.0), value)


def boosted_trees(
    train: DataFrame, test: DataFrame, n_classes: int, label: str, features: Sequence[str], weight: str, rounds: int, depth: int, rate: float, fit_rows: int | None = None,
) -> DataFrame:
    """Adds ``probs`` over the declared classes to the rows of ``test``.

    The model is fitted on all labelled rows of ``train``, with their weights scaled to a mean of one: up to
    ``TASK_ROWS`` in one task, more by ``fit_blocks``. A caller may ask for fewer, the ``fit_rows`` with the smallest
    hash. The model's size is bounded by rounds, classes and depth, so it is sent to the tasks that score.
    Null features count as missing and go left; rows without a label are not learned from; a class
    unseen in training gets probability 0. Without any labelled row ``probs`` is null.
    """
    many = len(features)
    x = [F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)]
    rows = settle(train.where(F.col(label).isNotNull()).select(*x, F.col(label).cast("long").alias("y"), F.col(weight).cast("double").alias("w")))
    if fit_rows is not None:
        rows = rows.orderBy(F.xxhash64("y", *(f"x{k}" for k in range(many))), *(f"x{k}" for k in range(many)), "y").limit(fit_rows)
    n = rows.count()
    held = rows.repartition(1)

    def learn(batches: Iterator[pa.RecordBatch]):
        t = pa.Table.from_batches(batches).to_pandas()
        if len(t):
            t = t.sort_values(list(t.columns), kind="stable")  # the order of float sums
            w = t["w"].to_numpy()
            # the least Hessian sum and the penalty are meant for rows that weigh one on average
            m = fit(t.iloc[:, :many].to_numpy(np.float64), t["y"].to_numpy(np.int64), w / (w.mean() or 1.0), rounds, depth, rate)
            flat = [pa.array([v.ravel()]) for v in (m.classes, m.feature, m.cut, m.value)]
            yield pa.RecordBatch.from_arrays(flat, ["classes", "feature", "cut", "value"])

    kept = test.columns
    schema = test.withColumn("probs", F.lit(None).cast("array<double>")).select(*kept, "probs").schema
    if n == 0:
        return test.select(*kept, F.lit(None).cast("array<double>").alias("probs"))
    if n > TASK_ROWS:
        model = fit_blocks(rows, many, n, rounds, depth, rate)
    else:
        found = settle(held.mapInArrow(learn, "classes array<long>, feature array<long>, cut array<double>, value array<double>")).first()
        shape = (rounds, len(found["classes"]), -1)
        model = Trees(np.array(found["classes"]), np.array(found["feature"]).reshape(shape), np.array(found["cut"]).reshape(shape), np.array(found["value"]).reshape(shape))
    sent = test.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            n = b.num_rows
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(kept), len(kept) + many)], axis=1) if n else np.zeros((0, many))
            p = sent.value.probabilities(x, n_classes)
            probs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n_classes, pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), probs], [*kept, "probs"])

    own = "x"
    while any(c.lower().startswith(own) for c in kept):  # a name that no column begins with
        own = f"_{own}"
    return test.select(*kept, *(F.col(c).cast("double").alias(f"{own}{k}") for k, c in enumerate(features))).mapInArrow(score, schema)
