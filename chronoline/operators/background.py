"""Matched background clips: a seeded draw from the time free of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronoline.functions.hashing import uniform
from chronoline.operators.blocks import DAILY, Blocks, neighbours
from chronoline.operators.intervals import cover_join, free_intervals, leading_records
from chronoline.session import settle


def _draw(pieces: Column, need: Column, u: Column) -> Column:
    """The free piece hit by u times the total usable length, in time order."""
    usable = F.transform(
        F.filter(pieces, lambda p: p["len"] > need),
        lambda p: F.struct(p["t_start"].alias("t_start"), (p["len"] - need).alias("w")),
    )
    target = u * F.aggregate(usable, F.lit(0.0), lambda a, p: a + p["w"])
    start = F.struct(
        F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("t_start"), F.lit(None).cast("double").alias("w")
    )

    def step(acc: Column, p: Column) -> Column:
        taken = acc["t_start"].isNotNull() & (target <= acc["cum"])
        return F.struct(
            F.when(taken, acc["cum"]).otherwise(acc["cum"] + p["w"]).alias("cum"),
            F.when(taken, acc["t_start"]).otherwise(p["t_start"]).alias("t_start"),
            F.when(taken, acc["w"]).otherwise(p["w"]).alias("w"),
        )

    return F.aggregate(usable, start, step)


def sample_background(
    events: DataFrame, recordings: DataFrame, blocked: DataFrame, pre: float = 10.0, post: float = 10.0,
    seed: int = 42, keys: Sequence[str] = ("session",), ident: str = "idx", blocks: Blocks = DAILY,
) -> DataFrame:
    """One background clip per event, as long as the event's clip, or null where none fits.

    The event's own recording is tried first, then the session's others in start
    order. "First recording with a free piece longer than x" is an as-of lookup on
    the recordings that raise the running maximum of their longest free piece, so
    events are never paired with all recordings. The pieces of one recording form a
    short array: blocked stretches include their padding, which bounds their number
    by recording length over padding.
    """
    keys = list(keys)
    need = F.col("t_end") - F.col("t_start") + F.lit(pre + post)
    free = free_intervals(recordings, blocked, 0.0, keys, blocks)
    per_rec = settle(free.groupBy(*keys, "path", "r_start").agg(
        F.max(F.col("t_end") - F.col("t_start")).alias("longest"),
        F.array_sort(F.collect_list(F.struct("t_start", (F.col("t_end") - F.col("t_start")).alias("len")))).alias("pieces"),
    ))
    ev = cover_join(events, recordings, "t_start", ("path",), keys, blocks=blocks).select(
        *keys, ident, need.alias("need"), F.col("path").alias("own_path")
    )
    own = per_rec.select(*keys, F.col("path").alias("own_path"), F.col("longest").alias("own_longest"))
    ev = settle(ev.join(own, [*keys, "own_path"], "left"))
    ladder = settle(
        leading_records(per_rec.select(*keys, "path", "r_start", "longest"), "r_start", "longest", keys, ("path",), blocks)
    )
    ev = neighbours(ev, ladder, keys, "need", "longest", ["path"], left_first=False, blocks=Blocks(3600.0, blocks.hot_rows), keep=("next",))
    ev = ev.withColumn(
        "path", F.when(F.col("own_longest") > F.col("need"), F.col("own_path")).otherwise(F.col("next.path"))
    )
    drawn = ev.join(per_rec.select(*keys, "path", "pieces"), [*keys, "path"], "left").withColumn(
        "_d", _draw(F.coalesce("pieces", F.expr("cast(array() as array<struct<t_start:double,len:double>>)")),
                    F.col("need"), uniform(F.col(ident), seed))
    )
    start = F.col("_d.t_start") + uniform(F.col(ident), seed + 1) * F.col("_d.w")
    return drawn.select(*keys, ident, "path", start.alias("clip_start"), (start + F.col("need")).alias("clip_end"))
