"""Score traces to events, events to matches, matches to detection scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoline.operators.blocks import BLK, DAILY, Blocks, assign, blocked, hot_blocks, neighbours
from chronoline.session import settle
from chronoline.operators.intervals import _final_start, _local_islands, _stitch, inside_any

THRESHOLDS = (0.5, 0.7, 0.9, 0.95, 0.99)


def linspace(lo: float, hi: float, n: int) -> tuple[float, ...]:
    return tuple(lo + (hi - lo) * i / (n - 1) for i in range(n))


def threshold_array(thresholds: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in thresholds])


def extract_events(
    trace: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    win: float = 4.0,
    min_dur: float = 4.0,
    merge_gap: float = 4.0,
    keys: Sequence[str] = ("session", "modality"),
    blocks: Blocks = DAILY,
    facts: bool = True,
) -> DataFrame:
    """Hits [t, t + win) with p >= thr, joined when at most ``merge_gap`` apart.

    The trace is shuffled once by (keys, block); thresholds fan out after that
    shuffle, because a partitioning by (keys, block) already serves windows by
    (keys, thr, block). Hits are equally long, so an earlier block reaches no further than
    the first event of a block: only the first and the last one are joined across blocks.
    Output: keys, thr, t_start, t_end and, unless ``facts`` is false, peak and n_hits; an
    event is identified by (keys, thr, t_start).
    """
    low = min(thresholds)
    hits = trace.filter(F.col("p") >= F.lit(low)).select(*keys, "t", "p")
    placed = assign(hits, keys, "t", blocks, hot_blocks([(hits, "t")], keys, blocks))
    # a given number of partitions: the rows are few here but multiply in the next step,
    # and adaptive execution would merge partitions by their size before it
    n = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(n, *keys, BLK).groupBy(*keys, BLK, "t").agg(F.max("p").alias("p"))
    passed = F.filter(threshold_array(thresholds), lambda x: x <= F.col("p"))
    fanned = placed.select(*keys, BLK, "t", "p", F.explode(passed).alias("thr")).withColumn(
        "_e", F.col("t") + F.lit(win)
    )
    full = [*keys, "thr"]
    local = _local_islands(fanned, full, "t", "_e", merge_gap)
    own = [F.max("p").alias("peak"), F.count(F.lit(1)).alias("n_hits")] if facts else []
    folded = [F.max("peak").alias("peak"), F.sum("n_hits").alias("n_hits")] if facts else []
    spec = W.partitionBy(*full, BLK).orderBy("_is")
    pieces = settle(local.groupBy(*full, BLK, "_is").agg(F.max("_e").alias("_e"), *own).withColumn(
        "_edge", F.lag("_is").over(spec).isNull() | F.lead("_is").over(spec).isNull()
    ))
    edges = pieces.filter("_edge")
    across = (
        edges.join(_stitch(edges, full, "_e", merge_gap), [*full, BLK], "left")
        .withColumn("t_start", _final_start(merge_gap))
        .groupBy(*full, "t_start")
        .agg(F.max("_e").alias("t_end"), *folded)
    )
    inside = pieces.filter(~F.col("_edge")).withColumnsRenamed({"_is": "t_start", "_e": "t_end"}).select(*across.columns)
    return across.unionAll(inside).filter(F.col("t_end") - F.col("t_start") >= F.lit(min_dur))


def candidate_pairs(
    events: DataFrame, truth: DataFrame, min_iou: float, keys: Sequence[str]
) -> DataFrame:
    """Event-truth pairs with temporal IoU >= min_iou, by an equi-join.

    IoU >= m bounds the ratio of the two lengths by 1/m, so lengths are binned on a
    log scale with base 1/m and each bin gets its own slot width. An event sends one
    row, a truth a constant number of rows, whatever their lengths are.
    """
    base = 1.0 / max(min_iou, 1e-3)
    if base < 1.5:
        base = 1.5
    level_of = lambda n: F.log(n) / F.lit(math.log(base))
    width = lambda lv: F.pow(F.lit(base), lv.cast("double") + 1)
    ev = events.withColumn("_lv", F.floor(level_of(F.col("t_end") - F.col("t_start"))).cast("int"))
    ev = ev.withColumn("_slot", F.floor(F.col("t_start") / width(F.col("_lv"))).cast("bigint"))
    gt = truth.select(
        *keys, "truth_id", F.col("t_start").alias("g_start"), F.col("t_end").alias("g_end")
    ).filter(F.col("g_end") > F.col("g_start"))
    reach = F.lit(math.log(1.0 / max(min_iou, 1e-3)) / math.log(base) + 1e-9)
    lv = level_of(F.col("g_end") - F.col("g_start"))
    gt = gt.withColumn("_lv", F.explode(F.sequence(F.floor(lv - reach).cast("int"), F.floor(lv + reach).cast("int"))))
    w = width(F.col("_lv"))
    gt = gt.withColumn(
        "_slot",
        F.explode(F.sequence(
            F.floor(F.col("g_start") / w).cast("bigint") - 1, F.floor(F.col("g_end") / w).cast("bigint")
        )),
    )
    inter = F.least("t_end", "g_end") - F.greatest("t_start", "g_start")
    hull = F.greatest("t_end", "g_end") - F.least("t_start", "g_start")
    return (
        ev.join(gt, [*keys, "_lv", "_slot"])
        .withColumn("iou", F.greatest(F.lit(0.0), inter) / hull)
        .filter((F.col("iou") > 0) & (F.col("iou") >= F.lit(min_iou)))
        .drop("_lv", "_slot")
    )


def _runs_of(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    """True where a row differs from the one before in any of the columns; nulls equal nulls."""
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        new[1:] = False
        for n in names:
            c = t.column(n).combine_chunks()
            a, b = c.slice(1), c.slice(0, t.num_rows - 1)
            differ = pc.fill_null(pc.not_equal(a, b), False)
            new[1:] |= pc.or_(differ, pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return new


def _settle_truths(full: Sequence[str]):
    """Decide the truths of each block in order, as far as the block alone allows.

    Rows are pairs, sorted by block, truth and preference. A truth takes its best free detection
    unless an earlier truth that is still open, here or in another block (``_o``), may take that one;
    then it stays open with its free pairs. Sends the pairs taken and those left open.
    """
    truth = ["truth_id", "g_start", "g_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: set = set()
        waiting: set = set()
        held: pa.Table | None = None
        last: pa.Table | None = None  # the last row decided: the block may go on

        def decide(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal last
            whole = t if last is None else pa.concat_tables([last, t])
            fresh = _runs_of(whole, [*full, BLK])[0 if last is None else 1 :]
            first = np.flatnonzero(_runs_of(t, [*full, BLK, *truth]) | fresh)
            s, e = t.column("t_start").to_pylist(), t.column("t_end").to_pylist()
            own = list(zip(*(t.column(c).to_pylist() for c in truth)))
            rival = t.column("_o").to_pylist()
            taken, left = [], []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), t.num_rows]):
                if fresh[a]:
                    used.clear()
                    waiting.clear()
                free = [k for k in range(a, b) if (s[k], e[k]) not in used]
                if not free:
                    continue
                k = free[0]
                o = rival[k]
                if (s[k], e[k]) in waiting or o is not None and (o["truth_id"], o["g_start"], o["g_end"]) < own[k]:
                    waiting.update((s[j], e[j]) for j in free)
                    left += free
                else:
                    used.add((s[k], e[k]))
                    taken.append(k)
            last = t.slice(t.num_rows - 1)
            for rows, open_ in ((taken, False), (left, True)):
                if rows:
                    out = t.take(pa.array(rows)).drop_columns(["_o"]).append_column("_open", pa.array([open_] * len(rows)))
                    yield from out.to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            ends = np.flatnonzero(_runs_of(held, [*full, BLK, *truth]))
            if len(ends) and ends[-1] > 0:  # the last truth may go on in the next batch
                yield from decide(held.slice(0, int(ends[-1])))
                held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            yield from decide(held)

    return run


def match_events(
    events: DataFrame,
    truth: DataFrame,
    min_iou: float = 0.3,
    keys: Sequence[str] = ("session",),
    groups: Sequence[str] = ("modality", "thr"),
    blocks: Blocks = DAILY,
) -> DataFrame:
    """Greedy one-to-one matching of truths, in order, to their best unused event.

    Detections may overlap; one is told by its start and end. The pairs are a conflict graph that
    is settled by rounds. In a round the truths of each time block are decided in order, in one
    task; a truth whose best free detection an earlier open truth of another block shares waits.
    What is left open, with detections taken elsewhere removed, goes to a round with wider blocks.
    The earliest open truth is always decided, so the rounds end; without pairs across blocks
    there is one. A block with too many pairs is cut, so no task holds a session or a chain.

    Output: keys, groups, truth_id, t_start, t_end, g_start, g_end, iou.
    """
    if not 0.0 < min_iou <= 1.0:
        raise ValueError("min_iou must be in (0, 1]")
    full = [*keys, *groups]
    columns = [*full, "truth_id", "t_start", "t_end", "g_start", "g_end", "iou"]
    pairs = candidate_pairs(events, truth, min_iou, keys).withColumn("truth_id", F.col("truth_id").cast("bigint"))
    open_ = settle(pairs.select(*columns))
    det, rounds = [*full, "t_start", "t_end"], []
    while True:
        placed = blocked(open_, full, "g_start", blocks)
        # detections with pairs in several blocks: the earliest truth of each block, then of the others
        per = placed.groupBy(*det, BLK).agg(F.min(F.struct("truth_id", "g_start", "g_end")).alias("_m"))
        across = per.groupBy(*det).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_m", BLK)).alias("_1")).filter("_n > 1").drop("_n")
        across = settle(across)
        if across.isEmpty():
            ready = placed.withColumn("_o", F.lit(None).cast("struct<truth_id:bigint,g_start:double,g_end:double>"))
        else:
            others = per.join(across, det).filter(F.col(BLK) != F.col(f"_1.{BLK}")).groupBy(*det).agg(F.min("_m").alias("_2"))
            rival = F.when(F.col(f"_1.{BLK}") == F.col(BLK), F.col("_2")).otherwise(F.col("_1._m"))
            ready = placed.join(across.join(others, det), det, "left").withColumn("_o", rival).drop("_1", "_2")
        ready = ready.select(*columns, BLK, "_o").repartition(*full, BLK).sortWithinPartitions(
            *full, BLK, "truth_id", "g_start", "g_end", F.desc("iou"), "t_start", "t_end"
        )
        schema = ready.drop("_o").withColumn("_open", F.lit(True)).schema
        done = settle(ready.mapInArrow(_settle_truths(full), schema))
        rounds.append(done.filter(~F.col("_open")).select(*columns))
        left = done.filter("_open").select(*columns)
        if across.isEmpty() or left.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        open_ = settle(left.join(rounds[-1].select(*det), det, "left_anti"))
        blocks = replace(blocks, width=blocks.width * 8)


def trace_hours(trace: DataFrame, preferred: str = "video", keys: Sequence[str] = ("session",)) -> DataFrame:
    """Recording hours from the span of the preferred modality, else of any."""
    span = lambda c: (F.max(c) - F.min(c)) / F.lit(3600.0)
    own = F.when(F.col("modality") == preferred, F.col("t"))
    return trace.groupBy(*keys).agg(F.coalesce(span(own), span(F.col("t"))).alias("hours"))


def score_grid(trace: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ("session",)) -> DataFrame:
    """Every (session, modality, thr) that must appear in a report, detections or not."""
    return trace.select(*keys, "modality").distinct().select(
        *keys, "modality", F.explode(threshold_array(thresholds)).alias("thr")
    )


def score_events(
    events: DataFrame,
    matches: DataFrame,
    truth: DataFrame,
    grid: DataFrame,
    hours: DataFrame,
    keys: Sequence[str] = ("session",),
) -> DataFrame:
    """Detection scores per session, modality and threshold."""
    full = [*keys, "modality", "thr"]
    det = events.groupBy(*full).agg(F.count(F.lit(1)).alias("n_det"))
    hit = matches.groupBy(*full).agg(
        F.count(F.lit(1)).alias("tp"),
        F.avg(F.abs(F.col("t_start") - F.col("g_start"))).alias("onset_mae"),
        F.avg(F.abs(F.col("t_end") - F.col("g_end"))).alias("offset_mae"),
        F.avg("iou").alias("mean_iou"),
    )
    n_gt = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    j = grid.join(det, full, "left").join(hit, full, "left").join(n_gt, list(keys), "left").join(
        hours, list(keys), "left"
    )
    j = j.withColumn("n_det", z("n_det")).withColumn("tp", z("tp")).withColumn("n_gt", z("n_gt"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return j.select(
        *full, "n_det", "tp", (F.col("n_det") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"),
        ratio(F.col("tp"), F.col("n_gt")).alias("recall"), ratio(F.col("tp"), F.col("n_det")).alias("precision"),
        ratio(F.col("n_det") - F.col("tp"), F.col("hours")).alias("fp_per_hour"),
        "onset_mae", "offset_mae", F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"),
    )


def detected_events(events: DataFrame, matches: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Events with peak score and their match, if any.

    The peak needs no range join: every trace point of an event at or above the
    threshold is one of its hits, and the others are lower.
    """
    full = [*keys, "modality", "thr", "t_start"]
    m = matches.select(*full, "truth_id", "iou")
    return events.join(m, full, "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def false_alarms(events: DataFrame, matches: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Events no truth was matched to."""
    return events.join(matches, [*keys, "modality", "thr", "t_start"], "left_anti")


def missed_truths(
    truth: DataFrame, matches: DataFrame, grid: DataFrame, keys: Sequence[str] = ("session",)
) -> DataFrame:
    """Truths without a match, per modality and threshold."""
    full = [*keys, "modality", "thr", "truth_id"]
    return grid.join(truth, list(keys)).join(matches, full, "left_anti")


def operating_curve(
    trace: DataFrame, truth: DataFrame, hours: DataFrame, thresholds: Sequence[float] = linspace(0.05, 0.99, 40),
    win: float = 4.0, min_dur: float = 4.0, merge_gap: float = 4.0, min_iou: float = 0.3,
    keys: Sequence[str] = ("session",), blocks: Blocks = DAILY,
) -> DataFrame:
    """False alarms per hour and sensitivity at many thresholds."""
    ev = settle(extract_events(trace, thresholds, win, min_dur, merge_gap, [*keys, "modality"], blocks, facts=False))
    m = match_events(ev, truth, min_iou, keys, blocks=blocks)
    grid = score_grid(trace, thresholds, keys)
    return score_events(ev, m, truth, grid, hours, keys).select(
        *keys, "modality", "thr", "fp_per_hour", F.col("recall").alias("sensitivity")
    )


def label_trace(
    trace: DataFrame, truth: DataFrame, win: float = 4.0, keys: Sequence[str] = ("session",), blocks: Blocks = DAILY
) -> DataFrame:
    """Window-centre membership in any truth, as y in {0, 1}."""
    flagged = settle(inside_any(trace, truth, F.col("t") + F.lit(win / 2.0), "_in", keys, blocks=blocks))
    return flagged.withColumn("y", F.col("_in").cast("int")).drop("_in")


def trace_summary(
    trace: DataFrame, truth: DataFrame, thr: float = 0.5, keys: Sequence[str] = ("session",), blocks: Blocks = DAILY
) -> DataFrame:
    """Count, span, mean score, share above threshold and mean score inside truth."""
    inside = inside_any(trace, truth, "t", "_in", keys, blocks=blocks)
    return inside.groupBy(*keys, "modality").agg(
        F.count(F.lit(1)).alias("n"), ((F.max("t") - F.min("t")) / 3600.0).alias("span_h"), F.avg("p").alias("mean_p"),
        F.avg((F.col("p") >= F.lit(thr)).cast("double")).alias("share_above"),
        F.count_if("_in").alias("n_inside"), F.avg(F.when(F.col("_in"), F.col("p"))).alias("mean_p_inside"),
    )


_FUSE = {
    "mean": lambda a, b, w: F.lit(w) * a + F.lit(1.0 - w) * b,
    "max": lambda a, b, w: F.greatest(a, b),
    "or": lambda a, b, w: F.greatest(a, b),
    "and": lambda a, b, w: F.least(a, b),
}


def asof_join(
    left: DataFrame, right: DataFrame, on: str = "t", by: Sequence[str] = ("session",), values: Sequence[str] = ("p",),
    tail: str = "last", blocks: Blocks = DAILY,
) -> DataFrame:
    """Forward as-of: first right row at or after the left time; past the end, the last one."""
    keep = ("prev", "next") if tail == "last" else ("next",)
    hit = neighbours(left, right, by, on, on, list(values), left_first=True, blocks=blocks, keep=keep)
    pick = lambda v: F.coalesce(*[F.col(f"{k}.{v}") for k in reversed(keep)])
    return hit.select(*left.columns, *[pick(v).alias(f"{v}_right") for v in values])


def fuse(
    left: DataFrame, right: DataFrame, how: str = "mean", weight: float = 0.5, by: Sequence[str] = ("session",),
    blocks: Blocks = DAILY,
) -> DataFrame:
    """Late fusion of two traces on the left one's axis (M04); sessions lacking the right one drop out."""
    j = asof_join(left, right, "t", by, ("p",), "last", blocks).filter(F.col("p_right").isNotNull())
    return j.select(*by, "t", _FUSE[how](F.col("p"), F.col("p_right"), weight).alias("p"))
