"""Ranked lexical search over posting lists in geometric blocks, exact.

A document is a sparse vector of term gains, a query one of term weights, the score their product in
whole numbers. The search answers a pack of queries against all documents:

1. One pass over the texts keeps, for each document, its number of terms and those that a query asks.
2. Documents of each query's rarest terms give a first threshold: a score that ``k`` documents reach.
   Terms whose largest products together stay below it can't lift a document of none of the other
   terms to it, so only the other lists are built.
3. Documents are dealt into shards. In a shard each list is clustered: members go to the most alike
   of some of them, and a cluster is a block with its coordinatewise maximum, over the terms that
   queries ask together with the list's.
4. A query walks the blocks of its lists from the largest bound down, scores their members on the whole
   vectors, and stops where a bound is below the score it has to reach. Bounds are exact sums over
   maxima, so nothing that could be ranked is passed over. Each shard sends ``k`` rows a query.

Queries travel in packs of about ``PACK`` different terms, so what is sent to the tasks is bounded;
more queries are more packs.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chronoline.llm.terms import spaced_terms
from chronoline.session import settle

#: Documents of a shard, members of a block (about), terms of a pack of queries (about).
SHARD, BLOCK, PACK = 16_384, 32, 1 << 20
#: Lists whose documents give the first threshold; blocks scored before the threshold is looked at again.
SEEDS, STEP = 3, 16
#: Columns in which members are compared for clustering.
FOLD = 128
#: Bytes of a text that are split at a time.
PIECE = 1 << 22

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")


def count_terms(text: str) -> Counter:
    """The terms of a whole text, A-Z lowered, as UTF-8 with their occurrences."""
    raw = text.encode().lower()  # bytes: only A-Z are lowered
    if len(raw) <= PIECE:
        return Counter(_TERM.findall(raw))
    total, at = Counter(), 0
    while at < len(raw):
        cut = _BETWEEN.search(raw, at + PIECE)
        end = cut.end() if cut else len(raw)
        total.update(_TERM.findall(raw[at:end]))
        at = end
    return total


class Pack:
    """Some queries: their ids and, in ``start``, ``term`` and ``repeat``, the numbered terms of each."""

    def __init__(self, rows):
        self.terms = sorted({r["term"] for r in rows})
        number = {t: k for k, t in enumerate(self.terms)}
        by: dict = {}
        for r in rows:
            by.setdefault(r["item"], []).append((number[r["term"]], r["repeats"]))
        self.items = list(by)
        self.start = np.concatenate([[0], np.cumsum([len(v) for v in by.values()])]).astype(np.int64)
        flat = [x for v in by.values() for x in sorted(v)]
        self.term = np.array([t for t, _ in flat], np.int64)
        self.repeat = np.array([n for _, n in flat], np.int64)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
        self.weight = self.repeat * np.array(w, np.int64)[self.term]

    def query(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.start[k], self.start[k + 1])
        return self.term[part], self.weight[part]

    def need(self, least: np.ndarray, top: np.ndarray) -> None:
        """``least``: the score each query must reach; marks the terms whose lists it must walk.

        ``top`` has each term's largest gain. Lists are left from the least product up as long as
        all those left together stay below the score.
        """
        self.least = least
        self.walks = np.zeros(len(self.term), bool)
        for k in range(len(self.items)):
            term, weight = self.query(k)
            most = weight * top[term]
            order = np.argsort(most, kind="stable")
            left = np.cumsum(most[order]) < max(1, least[k])
            self.walks[self.start[k] + order[~left]] = True
        self.lists = np.unique(self.term[self.walks])

    def askers(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, query): the queries that walk each list."""
        own = np.repeat(np.arange(len(self.items)), np.diff(self.start))[self.walks]
        term = self.term[self.walks]
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.append(self.lists, len(self.terms))), own[order]


def packs(items: DataFrame, ident: str, text: str) -> list[Pack]:
    """Queries of at most about ``PACK`` terms together; rows of one id are one query."""
    terms = F.explode(F.filter(F.split(spaced_terms(F.col(text)), " "), lambda w: w != ""))
    counted = settle(items.select(F.col(ident).alias("item"), terms.alias("term")).groupBy("item", "term").agg(F.count("*").alias("repeats")))
    many = max(1, -(-counted.count() // PACK))
    dealt = counted.withColumn("pack", F.pmod(F.xxhash64("item"), F.lit(many)))
    found = (Pack(dealt.where(F.col("pack") == k).collect()) for k in range(many))  # about PACK rows each
    return [p for p in found if p.items]


def vectors(docs: DataFrame, terms: list[str], ident: str, text: str) -> DataFrame:
    """(doc, n, term, tf) of the documents with terms: how many, and the asked ones with their occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast([t.encode() for t in terms])  # a pack's terms

    def run(batches):
        number = {t: k for k, t in enumerate(sent.value)}
        for b in batches:
            keep, sizes, ends, term, tf = [], [], [0], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                counts = count_terms(t) if t else None
                if not counts:
                    continue
                keep.append(row)
                sizes.append(counts.total())
                own = sorted(number[w] for w in counts.keys() & number.keys())
                term += own
                tf += [counts[sent.value[k]] for k in own]
                ends.append(len(term))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(at, pa.array(term, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64())),
            ], ["doc", "n", "term", "tf"])

    kinds = {"n": "long", "term": "array<int>", "tf": "array<long>"}
    schema = docs.select(F.col(ident).alias("doc"), *(F.lit(None).cast(v).alias(c) for c, v in kinds.items())).schema
    return docs.select(ident, text).mapInArrow(run, schema)


def gains(n: np.ndarray, tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The gain of each of the terms ``tf`` of documents of ``n`` terms; ``size`` asked terms a document."""
    if len(n) and 75 * int(n.max()) * n_docs >= 2**63:
        m = np.array([100 - 75 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    else:
        m = 100 - 75 + 75 * n * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of an Arrow list array without nulls."""
    at = column.offsets.to_numpy()
    return at - at[0], column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)


def products(start: np.ndarray, term: np.ndarray, gain: np.ndarray, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Whole-number scores of some documents; ``weight`` has one entry for each term."""
    size = start[docs + 1] - start[docs]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(start[docs] - ends[:-1], size)
    total = np.concatenate([[0], np.cumsum(weight[term[at]] * gain[at])])
    return total[ends[1:]] - total[ends[:-1]]


def _best(score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest scores above 0, ties by the smaller id."""
    order = np.lexsort((doc, -score))[:k]
    return order[score[order] > 0]


def first_thresholds(forward: DataFrame, pack: Pack, n_docs: int, n_terms: int, df: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, top): a score that ``k`` documents reach (0 if too few are seen), and each term's largest gain."""
    sent = forward.sparkSession.sparkContext.broadcast(pack)

    def run(batches):
        p: Pack = sent.value
        top, kept = np.zeros(len(p.terms), np.int64), [np.zeros(0, np.int64)] * len(p.items)
        weight = np.zeros(len(p.terms), np.int64)
        for b in batches:
            start, term = _lists(b.column("term"))
            gain = gains(b.column("n").to_numpy(), _lists(b.column("tf"))[1], np.diff(start), n_docs, n_terms)
            np.maximum.at(top, term, gain)
            order = np.argsort(term, kind="stable")
            row, edge = np.repeat(np.arange(len(start) - 1), np.diff(start))[order], np.searchsorted(term[order], np.arange(len(p.terms) + 1))
            for q in range(len(p.items)):
                own, w = p.query(q)
                rare = own[np.argsort(-w, kind="stable")[:SEEDS]]
                docs = np.unique(np.concatenate([row[edge[t] : edge[t + 1]] for t in rare]))
                if len(docs):
                    weight[own] = w
                    score = np.concatenate([kept[q], products(start, term, gain, docs, weight)])
                    kept[q] = np.sort(score)[-k:]
                    weight[own] = 0
        some = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.array(top[some])], ["term", "query", "value"])
        size = [len(x) for x in kept]
        yield pa.RecordBatch.from_arrays([pa.nulls(sum(size), pa.int64()), pa.array(np.repeat(np.arange(len(kept)), size)), pa.array(np.concatenate(kept))], ["term", "query", "value"])

    seen = settle(forward.mapInArrow(run, "term long, query long, value long"))
    top, least = np.zeros(len(pack.terms), np.int64), np.zeros(len(pack.items), np.int64)
    for r in seen.where("term IS NOT NULL").groupBy("term").agg(F.max("value").alias("v")).collect():  # a pack's terms
        top[r["term"]] = r["v"]
    ranked = Window.partitionBy("query").orderBy(F.desc("value"))
    for r in seen.where("query IS NOT NULL").withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).collect():  # a pack's queries
        least[r["query"]] = r["value"]
    return least, top


def cluster(x: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each row: the most alike, by cosine, of ``blocks`` rows that lie evenly in the list."""
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    centre = unit[np.linspace(0, len(x) - 1, blocks).astype(np.int64)]
    out = np.empty(len(x), np.int64)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (unit[lo : lo + 4096] @ centre.T).argmax(axis=1)
    return out


def _maxima(cell: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order, and the largest gain of each."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    return cell[first], np.maximum.reduceat(gain[order], first) if len(cell) else gain


def blocked(start: np.ndarray, term: np.ndarray, gain: np.ndarray, pack: Pack, block: int) -> dict[str, np.ndarray]:
    """The lists of one shard in blocks: members and coordinatewise maxima.

    A list's blocks are ``list_start``; a block's members and maxima ``member_start`` and ``max_start``.
    """
    n = len(start) - 1
    size = np.diff(start)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(term, kind="stable")
    edge = np.searchsorted(term[order], np.arange(len(pack.terms) + 1))
    asked, askers = pack.askers()
    column = np.full(len(pack.terms), -1, np.int64)
    list_start, members, member_size, max_term, max_gain, max_size = [0], [], [], [], [], []
    for k, t in enumerate(pack.lists.tolist()):
        docs = row[order[edge[t] : edge[t + 1]]]
        if len(docs):
            together = np.unique(np.concatenate([pack.query(q)[0] for q in askers[asked[k] : asked[k + 1]].tolist()]))
            column[together] = np.arange(len(together))
            ends = np.concatenate([[0], np.cumsum(size[docs])])
            at = np.arange(ends[-1]) + np.repeat(start[docs] - ends[:-1], size[docs])
            col, own = column[term[at]], np.repeat(np.arange(len(docs)), size[docs])
            some = col >= 0
            col, own, g = col[some], own[some], gain[at[some]]
            column[together] = -1
            blocks = -(-len(docs) // block)
            label = np.zeros(len(docs), np.int64)
            if blocks > 1:
                wide = min(FOLD, len(together))
                x = np.bincount(own * wide + col % wide, weights=g, minlength=len(docs) * wide).reshape(-1, wide).astype(np.float32)
                _, label = np.unique(cluster(x, blocks), return_inverse=True)
                blocks = int(label.max()) + 1
            cell, most = _maxima(label[own] * len(together) + col, g)
            by = np.argsort(label, kind="stable")
            members.append(docs[by])
            member_size.append(np.bincount(label, minlength=blocks))
            max_term.append(together[cell % len(together)])
            max_gain.append(most)
            max_size.append(np.bincount(cell // len(together), minlength=blocks))
            list_start.append(list_start[-1] + blocks)
        else:
            list_start.append(list_start[-1])
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    ends = lambda sizes: np.concatenate([[0], np.cumsum(flat(sizes))]).astype(np.int64)
    return {
        "list_start": np.array(list_start, np.int64), "member_start": ends(member_size), "member": flat(members),
        "max_start": ends(max_size), "max_term": flat(max_term), "max_gain": flat(max_gain),
    }


_STARTS, _VALUES = ("start", "list_start", "member_start", "max_start"), ("term", "gain", "member", "max_term", "max_gain")


def build_index(forward: DataFrame, pack: Pack, n_docs: int, n_terms: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row for each shard of about ``shard`` documents: their ids and vectors, and its lists in blocks."""
    sent = forward.sparkSession.sparkContext.broadcast(pack)

    def build(batches):
        held = pa.Table.from_batches(batches)
        if not held.num_rows:
            return
        held = held.combine_chunks()
        start, term = _lists(held.column("term").combine_chunks())
        gain = gains(held.column("n").to_numpy(), _lists(held.column("tf").combine_chunks())[1], np.diff(start), n_docs, n_terms)
        parts = {"start": start, "term": term, "gain": gain} | blocked(start, term, gain, sent.value, block)
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        ids = held.column("doc").combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [one(ids, ids.type), *(one(parts[c], pa.int64()) for c in _STARTS), *(one(parts[c], pa.int32()) for c in _VALUES)], ["doc", *_STARTS, *_VALUES]
        )

    none = lambda names, kind: [F.lit(None).cast(kind).alias(c) for c in names]
    schema = forward.select(F.array("doc").alias("doc"), *none(_STARTS, "array<long>"), *none(_VALUES, "array<int>")).schema
    return settle(forward.repartition(max(1, -(-n_docs // shard))).mapInArrow(build, schema))


def walk(parts: dict[str, np.ndarray], rank: np.ndarray, pack: Pack, q: int, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, scored): a query's ``k`` best documents of a shard, and how many were scored.

    Only documents that reach the query's least score are looked for. ``weight`` is zero for all
    terms and is again at the end.
    """
    term, w = pack.query(q)
    lists = np.searchsorted(pack.lists, term[pack.walks[pack.start[q] : pack.start[q + 1]]])
    blocks = np.concatenate([np.arange(parts["list_start"][i], parts["list_start"][i + 1]) for i in lists] or [np.zeros(0, np.int64)])
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(blocks):
        return rows, scores, 0
    weight[term] = w
    bound = products(parts["max_start"], parts["max_term"], parts["max_gain"], blocks, weight)
    order = np.argsort(-bound, kind="stable")
    blocks, bound = blocks[order], bound[order]
    least, seen, scored = max(1, int(pack.least[q])), np.zeros(len(rank), bool), 0
    for lo in range(0, len(blocks), STEP):
        near = blocks[lo : lo + STEP][bound[lo : lo + STEP] >= least]
        if not len(near):
            break  # bounds only fall from here
        size = parts["member_start"][near + 1] - parts["member_start"][near]
        ends = np.concatenate([[0], np.cumsum(size)])
        docs = np.unique(parts["member"][np.arange(ends[-1]) + np.repeat(parts["member_start"][near] - ends[:-1], size)])
        docs = docs[~seen[docs]]
        seen[docs] = True
        scored += len(docs)
        rows, scores = np.concatenate([rows, docs]), np.concatenate([scores, products(parts["start"], parts["term"], parts["gain"], docs, weight)])
        best = _best(scores, rank[rows], k)
        rows, scores = rows[best], scores[best]
        if len(rows) == k:
            least = max(least, int(scores[-1]))
    weight[term] = 0
    good = scores >= pack.least[q]
    return rows[good], scores[good], scored


def search_index(index: DataFrame, pack: Pack, k: int) -> DataFrame:
    """(query, doc, score): the best ``k`` documents of each shard for each query of the pack."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(pack)

    def run(batches):
        p: Pack = sent.value
        weight = np.zeros(len(p.terms), np.int64)
        for b in batches:
            for r in range(b.num_rows):
                parts = {c: b.column(c)[r].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_STARTS, *_VALUES)}
                ids = b.column("doc")[r].values
                rank = pc.rank(ids, null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
                found = [(q, *walk(parts, rank, p, q, k, weight)[:2]) for q in range(len(p.items))]
                rows = np.concatenate([x for _, x, _ in found])
                query = np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(query), ids.take(pa.array(rows)), pa.array(np.concatenate([s for _, _, s in found]))], ["query", "doc", "score"])

    schema = index.select(F.lit(0).cast("long").alias("query"), F.element_at("doc", 1).alias("doc"), F.lit(0).cast("long").alias("score")).schema
    return index.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(item id, rank, doc id, score): each item's ``k`` highest-scoring documents with a score above 0.

    Ties go to the smaller document id, null ids last; repeated rows are documents of their own. Rows
    of one item id are one item. Null and empty texts have no terms; empty tables give no rows.
    Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    out = None
    for pack in packs(items, item, item_text):
        forward = settle(vectors(docs, pack.terms, ident, text))
        total = forward.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not total["docs"]:
            continue
        df = np.zeros(len(pack.terms), np.int64)
        for r in forward.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a pack's terms
            df[r["term"]] = r["count"]
        pack.weigh(total["docs"], df)
        pack.need(*first_thresholds(forward, pack, total["docs"], total["terms"], df, k))
        index = build_index(forward, pack, total["docs"], total["terms"], shard, block)
        found = search_index(index, pack, k)
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc")))).where(F.col("rank") <= k)
        kind = items.schema[item].dataType
        names = spark.createDataFrame([(q, x) for q, x in enumerate(pack.items)], items.select(F.lit(0).cast("long").alias("query"), F.lit(None).cast(kind).alias(item)).schema)
        named = settle(best).join(names, "query").select(item, "rank", F.col("doc").alias(ident), "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        zero = F.lit(0).cast("long")
        nothing = F.lit(None).cast(items.schema[item].dataType).alias(item)
        return docs.where("false").select(nothing, F.lit(0).alias("rank"), F.col(ident), zero.alias("score"))
    return out
