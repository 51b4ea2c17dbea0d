"""Operators along a session's time line: smoothing, merging files, clock checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from chronoline.operators.blocks import DAILY, Blocks, row_numbers


def moving_average(
    trace: DataFrame, k: int, keys: Sequence[str] = ("session", "modality"), value: str = "p", out: str = "smooth",
    blocks: Blocks = DAILY, chunk: int = 100_000,
) -> DataFrame:
    """Centred mean of k rows with zero-padded edges; short series stay as they are.

    Rows are numbered, cut into chunks, and each chunk borrows up to k / 2 rows from
    its neighbours, so no window spans a whole series. An even k takes one row more
    before than after.
    """
    half, after = k // 2, (k - 1) // 2
    rows = row_numbers(trace, keys, "t", "_i", blocks=blocks)
    chunk_of = lambda i: F.floor((i - 1) / F.lit(chunk)).cast("bigint")
    spread = rows.withColumn(
        "_chunk", F.explode(F.sequence(chunk_of(F.col("_i") - half), chunk_of(F.col("_i") + half)))
    ).withColumn("_own", F.col("_chunk") == chunk_of(F.col("_i")))
    spec = W.partitionBy(*keys, "_chunk").orderBy("_i")
    total = F.sum(value).over(spec.rowsBetween(-half, after))
    sizes = trace.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (
        spread.withColumn("_sum", total).filter("_own").join(sizes, list(keys))
        .withColumn(out, F.when((F.col("_n") > k) & F.lit(k > 1), F.col("_sum") / F.lit(float(k))).otherwise(F.col(value)))
        .select(*trace.columns, out)
    )


def merge_traces(traces: DataFrame, keys: Sequence[str] = ("session", "modality"), order: str = "file_ord") -> DataFrame:
    """Keep, per session and modality, the rows of the first file that has any."""
    first = traces.groupBy(*keys).agg(F.min(order).alias("_first"))
    return traces.join(first, list(keys)).filter(F.col(order) == F.col("_first")).drop("_first")


def clock_delta(
    video: DataFrame, signal: DataFrame, lo: float = 10.0, hi: float = 25.0, keys: Sequence[str] = ("session",)
) -> DataFrame:
    """First video start minus signal start, and whether it lies in the expected band (Q01)."""
    v = video.groupBy(*keys).agg(F.min("t_start").alias("_v"))
    e = signal.groupBy(*keys).agg(F.min("t_start").alias("_e"))
    delta = F.col("_v") - F.col("_e")
    return v.join(e, list(keys), "full_outer").select(
        *keys, delta.alias("delta_s"), F.coalesce(delta.between(lo, hi), F.lit(False)).alias("in_band")
    )


def session_qc(recordings: DataFrame, annotations: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """One row of input counts per session (Q05)."""
    from chronoline.operators.clips import label_counts

    r = recordings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_recordings"), F.count_if(F.col("dur_s").isNull()).alias("n_without_length")
    )
    a = label_counts(annotations, keys=keys)
    z = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    return r.join(a, list(keys), "left").select(
        *keys, "n_recordings", "n_without_length", z("total", "annotations_total"), z("kept", "annotations_kept"),
        z("excluded", "labels_excluded"),
    )


def session_inputs(
    recordings: DataFrame, annotations: DataFrame, signals: DataFrame, keep: Sequence[str] = (), include_spikes: bool = False,
    lo: float = 10.0, hi: float = 25.0, keys: Sequence[str] = ("session",),
) -> DataFrame:
    """The inputs' check of a session: missing sidecars, the signal file used and the clocks' distance (Q05).

    ``recordings`` has t_start and has_sidecar; those without a sidecar count as missing and place nothing.
    ``signals`` has path, t_start and t_end. The file used is the first, by path, that covers the start of the
    first annotation kept, else the first of all; ``covers`` tells which. The delta is the first placed video's
    start less that file's. Sessions without files, videos or annotations have nulls; nothing is
    paired but a session's files with its one first annotation.
    """
    from chronoline.operators.clips import keep_label

    keys = list(keys)
    r = recordings.groupBy(*keys).agg(
        F.count_if("has_sidecar").alias("n_recordings"), F.count_if(~F.col("has_sidecar")).alias("n_missing_sidecar"),
        F.min(F.when(F.col("has_sidecar"), F.col("t_start"))).alias("_v"),
    )
    a = annotations.filter(keep_label(F.col("label"), keep, include_spikes)).groupBy(*keys).agg(F.min("t_start").alias("_a"))
    covering = (F.col("t_start") <= F.col("_a")) & (F.col("_a") < F.col("t_end"))
    e = signals.join(a, keys, "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_signals"), F.min(F.struct("path", "t_start")).alias("_any"), F.min(F.when(covering, F.struct("path", "t_start"))).alias("_own"),
    )
    used = F.coalesce("_own", "_any")
    delta = F.col("_v") - used["t_start"]
    return r.join(e, keys, "left").select(
        *keys, "n_recordings", "n_missing_sidecar", F.coalesce("n_signals", F.lit(0).cast("bigint")).alias("n_signals"), used["path"].alias("signal_selected"),
        F.col("_own").isNotNull().alias("covers"), delta.alias("clock_delta_s"), delta.between(lo, hi).alias("clocks_agree"),
    )


def recording_length(
    files: DataFrame, start: str = "t_start", frames: str = "frames", fps: str = "fps", default_fps: float = 15.0
) -> DataFrame:
    """Length and end of each file from its frames, and why a file is not usable.

    A missing or zero rate counts as ``default_fps``. ``reason`` is ok, no_start or unreadable
    (no frames); the length and end of a file that is not ok are null.
    """
    reason = F.when(F.col(start).isNull(), "no_start").when(F.coalesce(F.col(frames), F.lit(0)) <= 0, "unreadable").otherwise("ok")
    rate = F.coalesce(F.when(F.col(fps) > 0, F.col(fps)), F.lit(default_fps))
    return files.withColumn("reason", reason).withColumn(
        "dur_s", F.when(F.col("reason") == "ok", F.col(frames) / rate)
    ).withColumn("t_end", F.col(start) + F.col("dur_s"))


def recorded_hours(recordings: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Hours of usable recordings, and how many files had no length."""
    return recordings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("dur_s").isNull()).alias("n_rejected"),
        (F.coalesce(F.sum("dur_s"), F.lit(0.0)) / 3600.0).alias("hours"),
    )


def place_by(
    df: DataFrame, measure: str, keys: Sequence[str], ties: Sequence[str], out: str = "place",
    blocks: Blocks = Blocks(width=0.01),
) -> DataFrame:
    """Position of every row when ordered by a measure."""
    return row_numbers(df, keys, measure, out, ties, blocks)
