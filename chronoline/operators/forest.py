"""Random forests whose trees are grown in parts, so that no task and no driver holds a whole tree.

Rows become one byte for each feature; equal ones are counted, not repeated. Every tree draws its own
bootstrap of all rows. The first splits of a tree come from a bounded sample and only deal the rows to
parts of some ``part_rows`` rows; below them each part is grown to pure leaves on all rows drawn, in a group of
its own, which scores the test rows that fall there. Votes are added up as whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoline.operators.boosting import _binned
from chronoline.operators.splits import class_weights
from chronoline.session import settle

#: Rows with the smallest hash that bin edges and first splits are taken from; rows in a part, about.
SAMPLE_ROWS, PART_ROWS = 20_000, 20_000
BINS, UNIT = 256, 2**40
#: Rows dealt to the parts together; parts that a task grows, about.
GATHERED, TOGETHER = 1 << 16, 8


def _order(key: np.ndarray, many: int) -> np.ndarray:
    """The stable order of whole numbers below ``many``; those of 16 bits are dealt by digits, not compared."""
    if many <= 1 << 16:
        return np.argsort(key.astype(np.uint16), kind="stable")
    low = np.argsort(key.astype(np.uint16), kind="stable")  # the last 16 bits
    return low[_order(key[low] >> 16, (many >> 16) + 1)]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, n_classes: int, depth: int, rng: np.random.Generator, least: int = 0) -> tuple[np.ndarray, ...]:
    """One tree on Gini impurity: (feature, cut, left child, depth, class weights) of its nodes; feature -1 marks a leaf.

    Each node looks at the root of the number of features, those that vary first. With ``least``, nodes
    of more rows are split whether it helps or not, near the middle if nothing tells, and others are not.
    """
    n, many = x.shape
    tries = max(1, int(np.ceil(np.sqrt(many))))
    hot = np.zeros((n, n_classes))
    hot[np.arange(n), y] = w
    live, own, k, nodes, levels = np.arange(n), np.zeros(n, np.int64), 1, 1, []
    for level in range(depth + 1):
        total = np.bincount(own * n_classes + y[live], w[live], k * n_classes).reshape(k, n_classes)
        feature, cut, left = np.full(k, -1), np.zeros(k, np.int64), np.full(k, -1)
        levels.append((feature, cut, left, np.full(k, level), total))
        wanted = np.bincount(own, minlength=k) > least if least else (total > 0).sum(axis=1) > 1
        if level == depth or not wanted.any():
            break
        slot = np.cumsum(wanted) - 1
        live, own, total, opened = live[wanted[own]], slot[own[wanted[own]]], total[wanted], np.flatnonzero(wanted)
        by = _order(own, len(opened))
        live, own = live[by], own[by]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[starts, len(own)])
        held = x.take(live, axis=0)
        flat, row = held.ravel(), np.arange(len(own)) * many
        varies = np.maximum.reduceat(held, starts) > np.minimum.reduceat(held, starts)
        looked = (rng.random(varies.shape) + ~varies).argsort(axis=1)[:, :tries]
        weight = total.sum(axis=1)
        best, at, cuts = np.full(len(opened), -np.inf), np.zeros(len(opened), np.int64), np.zeros(len(opened), np.int64)
        for j in range(tries):
            key = own * BINS + flat.take(row + looked[:, j].take(own))
            if len(opened) * BINS <= len(own):  # few nodes: counted, not sorted
                many_of = np.bincount(key, minlength=len(opened) * BINS)
                keys = np.flatnonzero(many_of)
                sums = np.cumsum(np.bincount(key * n_classes + y.take(live), w.take(live), len(many_of) * n_classes).reshape(-1, n_classes)[keys], axis=0)
                upto = np.cumsum(many_of[keys])
            else:
                order = _order(key, len(opened) * BINS)
                key = key.take(order)
                ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
                keys, upto = key[ends], ends + 1
                sums = np.cumsum(hot.take(live.take(order), axis=0), axis=0)[ends]
            node = keys // BINS
            edge = np.flatnonzero(node[1:] == node[:-1])
            if not len(edge):
                continue
            base = np.vstack([np.zeros(n_classes), sums[np.flatnonzero(node[1:] != node[:-1])]])
            s = node[edge]
            lower = sums[edge] - base[s]
            upper = total[s] - lower
            gain = (lower**2).sum(axis=1) / lower.sum(axis=1) + (upper**2).sum(axis=1) / upper.sum(axis=1) - (total[s] ** 2).sum(axis=1) / weight[s]
            if least:
                before = upto[edge] - starts[s]
                gain = gain + 1e-6 * weight[s] * np.minimum(before, sizes[s] - before) / sizes[s]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            top = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[first, len(s)])))
            which, place = np.unique(s[hit], return_index=True)
            better = top > best[which]
            which, edge = which[better], edge[hit[place[better]]]
            best[which], at[which], cuts[which] = top[better], looked[which, j], keys[edge] % BINS
        split = np.flatnonzero(best > -1e-9 * weight)
        if not len(split):
            break
        rank = np.full(len(opened), -1)
        rank[split] = np.arange(len(split))
        feature[opened[split]], cut[opened[split]], left[opened[split]] = at[split], cuts[split], nodes + 2 * np.arange(len(split))
        goes = rank[own] >= 0
        right = flat.take(row + at.take(own)) > cuts.take(own)
        live, own, k = live[goes], (2 * rank[own] + right)[goes], 2 * len(split)
        nodes += k
    return tuple(np.concatenate(c) for c in zip(*levels))


def leaf(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The leaf that each row falls into."""
    feature, cut, left = tree[:3]
    node, row = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(row):
        row = row[feature[node[row]] >= 0]
        here = node[row]
        node[row] = left[here] + (x[row, feature[here]] > cut[here])
    return node


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _tasks(parts: int) -> int:
    """Tasks that grow the parts: some parts each, one after another, since a part takes less than a task's start."""
    return max(min(parts, 64), min(4000, -(-parts // TOGETHER)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``GATHERED`` rows or somewhat more: each is dealt to the parts of all trees, in as many pieces."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def random_forest(
    train: DataFrame, test: DataFrame, n_classes: int, label: str, features: Sequence[str], trees: int, depth: int, seed: int, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Adds ``probs`` over the declared classes to the rows of ``test``; classes are balanced.

    Null features count as missing and go left; rows without a label are not learned from; without any
    labelled row ``probs`` is null.
    """
    if n_classes > 255:
        raise ValueError("a label must fit a byte")
    spark, many = test.sparkSession, len(features)
    own = "x"
    while any(c.lower().startswith(own) for c in test.columns):  # a name that no column begins with
        own = f"_{own}"
    x = [F.col(c).cast("double").alias(f"{own}{k}") for k, c in enumerate(features)]
    rows = settle(train.where(F.col(label).between(0, n_classes - 1)).select(*x, F.col(label).cast("int").alias("y")))
    named = [f"{own}{k}" for k in range(many)]
    sample = rows.orderBy(F.xxhash64("y", *named), *named, "y").limit(SAMPLE_ROWS).toPandas()
    balance = np.zeros(n_classes)
    for r in class_weights(rows.select("y"), n_classes).collect():
        balance[r["y"]] = r["weight"]
    known, edges = _binned(sample[named].to_numpy(np.float64), BINS)

    def binned(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            kept = b.num_columns - many
            codes = np.zeros((b.num_rows, many), np.uint8)
            for f in range(many):
                v = b.column(kept + f).to_numpy(zero_copy_only=False).astype(np.float64)
                codes[:, f] = np.searchsorted(edges[f], np.where(np.isnan(v), -np.inf, v), side="left")
            packed = pa.array([r.tobytes() for r in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], packed], [*b.schema.names[:kept], own])

    learned = settle(rows.select("y", *named).mapInArrow(binned, f"y int, {own} binary").groupBy(own, "y").agg(F.count("*").alias("n")))
    schema = test.withColumn(own, F.lit(None).cast("binary")).schema
    asked = settle(test.select("*", *x).mapInArrow(binned, schema))
    many_rows = learned.count()

    least = int(len(sample) * part_rows / max(1, many_rows))  # so many rows of the sample stand for a part

    def routes(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for t in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, t])
                drawn = rng.poisson(1.0, len(known))
                k = known[drawn > 0].astype(np.uint8)
                y = sample["y"].to_numpy()[drawn > 0]
                top = grow(k, y, (balance[y] / balance[y].mean()) * drawn[drawn > 0], n_classes, depth, rng, max(1, least))[:4]
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), *(pa.array([c], pa.list_(pa.int64())) for c in top)], ["tree", "feature", "cut", "left", "depth"])

    whole = (np.array([-1]), np.zeros(1, np.int64), np.array([-1]), np.zeros(1, np.int64))
    router = {t: whole for t in range(trees)}
    if many_rows > part_rows:
        ids = spark.range(0, trees, 1, min(trees, 32))
        for r in ids.mapInArrow(routes, "tree long, feature array<long>, cut array<long>, left array<long>, depth array<long>").collect():
            router[r["tree"]] = tuple(np.array(r[c]) for c in ("feature", "cut", "left", "depth"))
    sent = spark.sparkContext.broadcast(router)
    parts = sum(int((r[0] < 0).sum()) for r in router.values())

    def dealt(t: int, codes: np.ndarray, counts: np.ndarray):
        """The rows of one tree by part: codes as they are, how often each was drawn."""
        node = leaf(sent.value[t], codes)
        by = _order(node, len(sent.value[t][0]))
        ends = np.flatnonzero(np.diff(node[by], append=-1)) + 1
        for first, last in zip([0, *ends.tolist()], ends.tolist()):
            mine = by[first:last]
            yield t, int(node[mine[0]]), codes[mine].tobytes(), counts[mine].astype(np.int64).tobytes()

    def pieces(t: int, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cols = list(zip(*dealt(t, codes, counts))) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["tree", "part", "codes", "counts"])

    def drawn(batches: Iterator[pa.RecordBatch]):
        for b in _gathered(batches):
            codes = np.hstack([_bytes(b.column(1), many), b.column(0).to_numpy().astype(np.uint8)[:, None]])
            hashes, n = b.column(3).to_numpy(), b.column(2).to_numpy()
            # the draws of a row hang on the row alone, whatever the partitions
            draws = np.zeros((len(n), trees), np.int64)
            for k, (h, c) in enumerate(zip(hashes, n)):
                draws[k] = np.random.Generator(np.random.Philox(key=[int(h) & 2**64 - 1, seed])).poisson(c, trees)
            for t in range(trees):
                got = draws[:, t] > 0
                yield pieces(t, codes[got], draws[got, t])

    def put(batches: Iterator[pa.RecordBatch]):
        for b in _gathered(batches):
            codes = _bytes(b.column(0), many)
            for t in range(trees):
                yield pieces(t, codes, np.zeros(len(codes), np.int64))

    def judged(key, table):
        t, p = key[0].as_py(), key[1].as_py()
        told = np.array([bool(v) for v in table.column("learned").to_pylist()])
        at = np.flatnonzero(told)
        codes = table.column("codes").combine_chunks()
        seen = _bytes(codes.take(pa.array(at)), many + 1)
        counts = np.frombuffer(b"".join(table.column("counts").combine_chunks().take(pa.array(at)).to_pylist()), np.int64)
        order = np.argsort(np.ascontiguousarray(seen).view(f"S{many + 1}").ravel(), kind="stable")  # float sums need one order
        seen, counts = seen[order], counts[order]
        asks = _bytes(codes.take(pa.array(np.flatnonzero(~told))), many)
        votes = np.zeros((0, n_classes), np.int64)
        if len(seen) and len(asks):
            y = seen[:, many].astype(np.int64)
            rng = np.random.default_rng([seed, t, p])
            w = balance[y] * counts
            tree = grow(seen[:, :many], y, w / w.mean(), n_classes, depth - int(sent.value[t][3][p]), rng)
            share = tree[4] / tree[4].sum(axis=1, keepdims=True)
            votes = np.rint(share[leaf(tree, asks)] * UNIT).astype(np.int64)
        else:
            asks = asks[:0]
        return pa.Table.from_arrays([pa.array([r.tobytes() for r in asks], pa.binary()), *(pa.array(votes[:, c]) for c in range(n_classes))], [own, *(f"p{c}" for c in range(n_classes))])

    shape = "tree long, part long, codes binary, counts binary"
    lessons = learned.select("y", own, "n", F.xxhash64(own, "y").alias("h")).mapInArrow(drawn, shape).withColumn("learned", F.lit(True))
    questions = asked.select(own).distinct().mapInArrow(put, shape).withColumn("learned", F.lit(False))
    votes = lessons.unionAll(questions).repartition(_tasks(parts), "tree", "part").groupBy("tree", "part").applyInArrow(
        judged, ", ".join([f"{own} binary", *(f"p{c} long" for c in range(n_classes))]))
    added = votes.groupBy(own).agg(*(F.sum(f"p{c}").alias(f"p{c}") for c in range(n_classes)))
    all_votes = sum((F.col(f"p{c}") for c in range(1, n_classes)), F.col("p0"))
    probs = settle(added.select(own, F.array(*(F.col(f"p{c}") / all_votes for c in range(n_classes))).alias("_probs")))
    return asked.join(probs, own, "left").select(*(F.col(c) for c in test.columns), F.col("_probs").alias("probs"))
