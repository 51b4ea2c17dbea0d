"""Event clips: bounds, crops, labels, logs and outcome counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chronoline.functions.timefmt import clip_name, hms
from chronoline.operators.blocks import DAILY, Blocks, row_numbers
from chronoline.operators.intervals import cover_join


def clip_bounds(covered: DataFrame, pre: float = 10.0, post: float = 10.0) -> DataFrame:
    """Clip limits, seek offset and length inside the covering recording."""
    seek = F.greatest(F.lit(0.0), F.col("t_start") - F.col("rec_start") - F.lit(pre))
    want = F.col("t_end") - F.col("t_start") + F.lit(pre + post)
    has = F.col("rec_start").isNotNull()
    return (
        covered.withColumn("clip_start", F.col("t_start") - F.lit(pre))
        .withColumn("clip_end", F.col("t_end") + F.lit(post))
        .withColumn("seek_s", F.when(has, seek))
        .withColumn("clip_len", F.when(has, F.least(want, F.col("rec_end") - F.col("rec_start") - F.col("seek_s"))).otherwise(want))
        .withColumn("clip_name", clip_name(F.col("idx"), F.col("label"), F.col("t_start")))
        .withColumn("video_seek", F.when(has, hms(F.col("t_start") - F.col("rec_start"))).otherwise(F.lit("—")))
    )


def crop_windows(covered: DataFrame, pre: float = 10.0, post: float = 10.0, shortest: float = 1.0) -> DataFrame:
    """Crop limits inside the recording, with the reason a crop is refused."""
    t0 = F.greatest(F.lit(0.0), F.col("t_start") - F.lit(pre) - F.col("rec_start"))
    t1 = F.least(F.col("rec_end") - F.col("rec_start"), F.col("t_end") + F.lit(post) - F.col("rec_start"))
    return (
        covered.withColumn("crop_start", t0).withColumn("crop_end", t1)
        .withColumn(
            "crop_status",
            F.when(F.col("crop_end") <= F.col("crop_start"), "empty")
            .when(F.col("crop_end") - F.col("crop_start") < shortest, "too_short").otherwise("ok"),
        )
    )


def coverage(events: DataFrame, video: DataFrame, eeg: DataFrame, keys: Sequence[str] = ("session",), blocks: Blocks = DAILY) -> DataFrame:
    """Which of the two recordings hold each event's start."""
    cols = events.columns
    v = cover_join(events, video, keys=keys, blocks=blocks).withColumn("has_video", F.col("rec_start").isNotNull())
    v = v.select(*cols, "has_video")
    e = cover_join(v, eeg, keys=keys, blocks=blocks).withColumn("has_eeg", F.col("rec_start").isNotNull())
    return e.select(*cols, "has_video", "has_eeg")


def clip_outcomes(covered: DataFrame, session: str = "session") -> DataFrame:
    """Outcome counts per session and in total (session null)."""
    v, e = F.col("has_video"), F.col("has_eeg")
    return covered.rollup(session).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v & e).alias("both"), F.count_if(v & ~e).alias("video_only"),
        F.count_if(~v & e).alias("eeg_only"), F.count_if(~v & ~e).alias("skipped"),
    )


def event_log(covered: DataFrame, pre: float, post: float, keys: Sequence[str] = ("session",), blocks: Blocks = DAILY) -> DataFrame:
    """Log rows with the clip's order in its session."""
    numbered = row_numbers(covered, keys, "t_start", "clip_n", ("idx",), blocks)
    bounds = clip_bounds(numbered, pre, post)
    status = F.when(F.col("rec_start").isNull(), "NO_COVERAGE").otherwise("OK")
    return bounds.withColumn("clip_len", F.col("t_end") - F.col("t_start") + F.lit(pre + post)).withColumn("video_status", status)


def keep_label(label, keep: Sequence[str] = (), include_spikes: bool = False):
    """Label predicate: no spikes unless asked for, and any of the given substrings."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    ok = F.lit(True) if include_spikes else ~low.contains("spike")
    if keep:
        hit = F.lit(False)
        for k in keep:
            hit = hit | low.contains(k.lower())
        ok = ok & hit
    return ok


def label_counts(
    annotations: DataFrame, keep: Sequence[str] = (), include_spikes: bool = False, keys: Sequence[str] = ("session",)
) -> DataFrame:
    """Kept and excluded annotations per session, in one pass."""
    ok = keep_label(F.col("label"), keep, include_spikes)
    return annotations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("excluded")
    )
