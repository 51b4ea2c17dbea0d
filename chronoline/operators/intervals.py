"""Interval algebra and interval joins, linear in the rows and free of pair blow-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoline.operators.blocks import BLK, DAILY, Blocks, Run, blocked, neighbours, running
from chronoline.session import settle


def recording_intervals(
    recordings: DataFrame,
    default_len: float = 4 * 3600.0,
    keys: Sequence[str] = ("session",),
    blocks: Blocks = DAILY,
) -> DataFrame:
    """End of each recording: own length, else the next start, else a default length."""
    nxt = running(
        recordings, keys, "t_start", [Run("_next", "nearest", F.col("t_start"), "after")],
        ties=("path",), blocks=blocks,
    )
    own = F.when(F.col("dur_s") > 0, F.col("t_start") + F.col("dur_s"))
    end = F.coalesce(own, F.col("_next"), F.col("t_start") + F.lit(default_len))
    return nxt.withColumn("t_end", end).withColumn("dur_s", F.col("t_end") - F.col("t_start")).drop("_next")


def _local_islands(rows: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, ties=()) -> DataFrame:
    """Island start of every row as seen inside its own block (column ``_is``)."""
    spec = W.partitionBy(*keys, BLK).orderBy(start, *ties)
    prev_end = F.max(end).over(spec.rowsBetween(W.unboundedPreceding, -1))
    opens = prev_end.isNull() | (F.col(start) - prev_end > F.lit(gap))
    rows = rows.withColumn("_open", F.when(opens, F.col(start)))
    return rows.withColumn(
        "_is", F.max("_open").over(spec.rowsBetween(W.unboundedPreceding, 0))
    ).drop("_open")


def _stitch(local: DataFrame, keys: Sequence[str], end: str, gap: float) -> DataFrame:
    """Per block: the end reached before it and the island still open there.

    Islands inside a block are disjoint, so what earlier blocks can swallow is a
    prefix of them. Two numbers per block decide it: its last island start and
    its largest end.
    """
    per_block = local.groupBy(*keys, BLK).agg(F.max(end).alias("_max_end"), F.max("_is").alias("_last_is"))
    spec = W.partitionBy(*keys).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    reached = per_block.withColumn("_reach", F.max("_max_end").over(spec))
    opens = F.col("_reach").isNull() | (F.col("_last_is") - F.col("_reach") > F.lit(gap))
    reached = reached.withColumn("_opened", F.when(opens, F.col("_last_is")))
    # the block's own last island opens a new run; otherwise an earlier one is still
    # open -- unless the block's first island did, which is then that last one too
    return reached.withColumn("_carry_is", F.max("_opened").over(spec)).select(*keys, BLK, "_reach", "_carry_is")


def _final_start(gap: float) -> Column:
    swallowed = F.col("_reach").isNotNull() & (F.col("_is") - F.col("_reach") <= F.lit(gap))
    return F.when(swallowed, F.col("_carry_is")).otherwise(F.col("_is"))


def assign_islands(
    df: DataFrame,
    start: str,
    end: str,
    gap: float = 0.0,
    keys: Sequence[str] = ("session",),
    ties: Sequence[str] = (),
    out: str = "island_start",
    blocks: Blocks = DAILY,
) -> DataFrame:
    """Mark every interval with the start of the merged run it belongs to."""
    local = _local_islands(blocked(df, keys, start, blocks), keys, start, end, gap, ties)
    stitched = _stitch(local, keys, end, gap)
    return local.join(stitched, [*keys, BLK], "left").select(*df.columns, _final_start(gap).alias(out))


def merge_intervals(
    df: DataFrame,
    start: str = "t_start",
    end: str = "t_end",
    gap: float = 0.0,
    pad_before: float = 0.0,
    pad_after: float = 0.0,
    keys: Sequence[str] = ("session",),
    extra: dict[str, tuple[str, str]] | None = None,
    blocks: Blocks = DAILY,
) -> DataFrame:
    """Union of intervals per key; runs whose distance is at most ``gap`` become one.

    ``extra`` maps an output name to (column, "max" | "min" | "sum") carried per run.
    """
    extra = extra or {}
    padded = df.select(
        *keys, (F.col(start) - F.lit(pad_before)).alias("_s"), (F.col(end) + F.lit(pad_after)).alias("_e"),
        *[F.col(c).alias(f"_x_{o}") for o, (c, _) in extra.items()],
    )
    fold = {"max": F.max, "min": F.min, "sum": F.sum}
    # equal starts collapse before the shuffle
    rows = padded.groupBy(*keys, "_s").agg(
        F.max("_e").alias("_e"), *[fold[k](f"_x_{o}").alias(f"_x_{o}") for o, (_, k) in extra.items()]
    )
    local = _local_islands(blocked(rows, keys, "_s", blocks), keys, "_s", "_e", gap)
    pieces = local.groupBy(*keys, BLK, "_is").agg(
        F.max("_e").alias("_e"), *[fold[k](f"_x_{o}").alias(f"_x_{o}") for o, (_, k) in extra.items()]
    )
    whole = pieces.join(_stitch(pieces, keys, "_e", gap), [*keys, BLK], "left")
    return (
        whole.withColumn(start, _final_start(gap))
        .groupBy(*keys, start)
        .agg(F.max("_e").alias(end), *[fold[k](f"_x_{o}").alias(o) for o, (_, k) in extra.items()])
    )


def leading_records(
    df: DataFrame, order: str, value: str, keys: Sequence[str], ties: Sequence[str] = (), blocks: Blocks = DAILY
) -> DataFrame:
    """Rows whose value exceeds every earlier one.

    In this subset order and value rise together, so "the first row in order with a
    value above x" is an as-of lookup on the value.
    """
    top = running(df, keys, order, [Run("_top", "max", F.col(value), "before")], ties, blocks)
    return top.filter(F.col("_top").isNull() | (F.col(value) > F.col("_top"))).drop("_top")


def cover_join(
    points: DataFrame,
    recordings: DataFrame,
    on: str = "t_start",
    values: Sequence[str] = ("path",),
    keys: Sequence[str] = ("session",),
    ties: Sequence[str] = ("path",),
    how: str = "left",
    blocks: Blocks = DAILY,
) -> DataFrame:
    """First recording by start whose [t_start, t_end) holds the point.

    The first recording in start order with an end beyond the point is always one
    that raises the running maximum of ends, so the lookup is one as-of pass over
    those, and the cover test is left to a comparison. No pairs are formed.

    ``how`` is left, inner, or first: points that nothing covers then take the first
    recording of their keys.
    """
    rec = settle(leading_records(recordings, "t_start", "t_end", keys, ties, blocks))
    fields = list(dict.fromkeys(["t_start", "t_end", *values]))
    hit = neighbours(points, rec, keys, on, "t_end", fields, left_first=False, blocks=blocks, keep=("next",))
    covered = F.col("next.t_start") <= F.col(on)
    out = hit.select(
        *points.columns,
        F.when(covered, F.col("next.t_start")).alias("rec_start"),
        F.when(covered, F.col("next.t_end")).alias("rec_end"),
        *[F.when(covered, F.col(f"next.{v}")).alias(v) for v in values],
    )
    if how == "first":
        start = recordings.groupBy(*keys).agg(F.min_by(
            F.struct("t_start", "t_end", *values), F.struct("t_start", *ties)
        ).alias("_first"))
        pick = lambda c, f: F.when(F.col("rec_start").isNotNull(), F.col(c)).otherwise(F.col(f"_first.{f}")).alias(c)
        out = out.join(start, list(keys), "left").select(
            *points.columns, pick("rec_start", "t_start"), pick("rec_end", "t_end"), *[pick(v, v) for v in values],
        )
    return out.filter(F.col("rec_start").isNotNull()) if how == "inner" else out


def nearest_recording(
    points: DataFrame,
    recordings: DataFrame,
    on: str = "t_start",
    keys: Sequence[str] = ("session",),
    blocks: Blocks = DAILY,
) -> DataFrame:
    """Recording with the closest start, earliest on ties, and the signed gap to its end."""
    first_at = settle(recordings.groupBy(*keys, "t_start").agg(
        F.min_by(F.struct("path", "t_end"), F.col("path")).alias("_r")
    ).select(*keys, "t_start", F.col("_r.path").alias("path"), F.col("_r.t_end").alias("t_end")))
    near = neighbours(
        points, first_at, keys, on, "t_start", ["t_start", "t_end", "path"], left_first=False, blocks=blocks
    )
    back, ahead = F.col(on) - F.col("prev.t_start"), F.col("next.t_start") - F.col(on)
    use_prev = F.col("next").isNull() | (F.col("prev").isNotNull() & (back <= ahead))
    best = F.when(use_prev, F.col("prev")).otherwise(F.col("next"))
    return near.withColumn("_b", best).select(
        *points.columns, F.col("_b.path").alias("nearest_path"),
        (F.col(on) - F.col("_b.t_end")).alias("gap_s"),
    )


def inside_any(
    points: DataFrame,
    intervals: DataFrame,
    on: Column | str,
    out: str = "inside",
    keys: Sequence[str] = ("session",),
    start: str = "t_start",
    end: str = "t_end",
    blocks: Blocks = DAILY,
) -> DataFrame:
    """Flag points lying in any closed interval (J05): merge first, then one as-of pass."""
    merged = settle(merge_intervals(intervals, start, end, keys=keys, blocks=blocks))
    probe = points.withColumn("_at", on if isinstance(on, Column) else F.col(on))
    hit = neighbours(probe, merged, keys, "_at", start, [end], left_first=False, blocks=blocks, keep=("prev",))
    flag = F.coalesce(F.col(f"prev.{end}") >= F.col("_at"), F.lit(False))
    return hit.select(*points.columns, flag.alias(out))


def starts_within(
    containers: DataFrame,
    items: DataFrame,
    keys: Sequence[str],
    c_start: str,
    c_end: str,
    i_start: str,
    width: float = 86_400.0,
) -> DataFrame:
    """Pairs where an item starts strictly inside a container.

    Containers are repeated once per time slot they touch (length / width + 1 rows)
    and meet the items by an equi-join on keys and slot.
    """
    slot = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    spread = containers.withColumn("_slot", F.explode(F.sequence(slot(F.col(c_start)), slot(F.col(c_end)))))
    return (
        spread.join(items.withColumn("_slot", slot(F.col(i_start))), [*keys, "_slot"])
        .filter((F.col(i_start) > F.col(c_start)) & (F.col(i_start) < F.col(c_end)))
        .drop("_slot")
    )


def free_intervals(
    bounds: DataFrame,
    blocked_iv: DataFrame,
    min_len: float = 0.0,
    keys: Sequence[str] = ("session",),
    blocks: Blocks = DAILY,
) -> DataFrame:
    """Time of each bound (path, t_start, t_end) not blocked, at least ``min_len`` long.

    ``blocked_iv`` must be merged. A free piece either begins at the bound's start (or
    where the block covering that start ends), found by an as-of pass, or right
    after a block that starts inside the bound.
    """
    b = blocked_iv.select(*keys, F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    b = settle(running(b, keys, "b_start", [Run("b_next", "nearest", F.col("b_start"), "after")], blocks=blocks))
    base = bounds.select(*keys, "path", F.col("t_start").alias("r_start"), F.col("t_end").alias("r_end"))
    head = neighbours(base, b, keys, "r_start", "b_start", ["b_start", "b_end"], left_first=False, blocks=blocks)
    head = head.select(
        *keys, "path", "r_start", "r_end",
        F.greatest(F.col("r_start"), F.col("prev.b_end")).alias("t_start"),
        F.least(F.col("r_end"), F.col("next.b_start")).alias("t_end"),
    )
    rest = starts_within(base, b, keys, "r_start", "r_end", "b_start").select(
        *keys, "path", "r_start", "r_end", F.col("b_end").alias("t_start"),
        F.least(F.col("r_end"), F.col("b_next")).alias("t_end"),
    )
    length = F.col("t_end") - F.col("t_start")
    return head.unionByName(rest).filter((length > 0) & (length >= F.lit(min_len)))


def label_windows(
    windows: DataFrame,
    events: DataFrame,
    min_overlap: float = 0.8,
    keys: Sequence[str] = ("clip_id",),
) -> DataFrame:
    """Window label: the clip's class when the event covers enough of the window, else 0.

    A clip holds one event, so this is an equi-join; ``windows`` has w_start, w_end and
    ``events`` has e_start, e_end, y.
    """
    j = windows.join(events.select(*keys, "e_start", "e_end", "y"), list(keys), "left")
    overlap = F.greatest(
        F.lit(0.0), F.least(F.col("w_end"), F.col("e_end")) - F.greatest(F.col("w_start"), F.col("e_start"))
    )
    enough = overlap >= F.lit(min_overlap) * (F.col("w_end") - F.col("w_start"))
    return j.withColumn("wlab", F.when(F.col("e_start").isNotNull() & enough, F.col("y")).otherwise(F.lit(0))).drop(
        "e_start", "e_end", "y"
    )
