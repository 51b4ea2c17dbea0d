"""Manifests and cohorts: discovery, audits, composition tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chronoline.functions.paths import base_name, clip_class, clip_dir, session_of, subject_of


def list_sessions(files: DataFrame, with_sheet: bool = False, sheet: str = r"\.(xlsx|csv)$") -> DataFrame:
    """Session folders, optionally only those holding a file whose name matches ``sheet``."""
    s = files.withColumn("session_key", session_of(clip_dir(F.col("path"))))
    if with_sheet:
        return s.groupBy("session_key").agg(F.count_if(base_name(F.col("path")).rlike(sheet)).alias("_n"), F.count(F.lit(1)).alias("files")).filter("_n > 0").drop("_n")
    return s.groupBy("session_key").agg(F.count(F.lit(1)).alias("files"))


def discover_clips(files: DataFrame) -> DataFrame:
    """Clip items: directories with a video and a known class."""
    videos = files.filter(base_name(F.col("path")) == "video.mp4").withColumn("clip", clip_dir(F.col("path")))
    items = videos.select("clip", clip_class(F.col("clip")).alias("y"), session_of(F.col("clip")).alias("session_key"), subject_of(F.col("clip")).alias("subject"))
    return items.filter(F.col("y").isNotNull()).dropDuplicates(["clip"])


def discovery_audit(files: DataFrame) -> DataFrame:
    """Why directories were not taken as clips."""
    d = files.withColumn("clip", clip_dir(F.col("path"))).groupBy("clip").agg(
        F.max((base_name(F.col("path")) == "video.mp4").cast("int")).alias("has_video")
    )
    reason = F.when(F.col("has_video") == 0, "no_video").when(clip_class(F.col("clip")).isNull(), "unknown_stage").otherwise("ok")
    return d.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def cohort_table(clips: DataFrame, classes: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Sessions, clips and clips per class of each subject, with a total row (subject null)."""
    return clips.rollup("subject").agg(
        F.count_distinct("session_key").alias("sessions"), F.count(F.lit(1)).alias("clips"),
        *[F.count_if(F.col("y") == c).alias(f"class_{c}") for c in classes],
    )


def hours_by_class(clips: DataFrame, duration: str = "duration") -> DataFrame:
    """Clips, hours and mean length of each class, with a total row (y null)."""
    return clips.rollup("y").agg(
        F.count(F.lit(1)).alias("clips"), (F.sum(duration) / 3600.0).alias("hours"), F.avg(duration).alias("mean_s")
    )


def missing_keys(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Keys a store lacks; reported, never filled in."""
    return wanted.select(key).distinct().join(store.select(key), key, "left_anti")


def reconcile(source: DataFrame, copy: DataFrame, key: str = "path", size: str = "length") -> DataFrame:
    """File-by-file comparison of two manifests with totals (row with null status is the total)."""
    j = source.select(key, F.col(size).alias("_a")).join(copy.select(key, F.col(size).alias("_b")), key, "full_outer")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "size_differs").otherwise("same")
    return j.withColumn("status", status).rollup("status").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("_a"), F.lit(0)).alias("source_bytes"), F.coalesce(F.sum("_b"), F.lit(0)).alias("copy_bytes")
    )


def recover_items(items: DataFrame, predictions: DataFrame, order: str, idx: str = "idx", label: str = "y") -> DataFrame:
    """Join stored positions back to items in a declared order and flag label mismatches."""
    from chronoline.operators.blocks import Blocks, row_numbers

    placed = row_numbers(items, [], order, "_n", blocks=Blocks(width=10_000.0)).withColumn(idx, F.col("_n") - 1).drop("_n")
    j = predictions.join(placed.withColumnRenamed(label, "_item_y"), idx, "left")
    return j.withColumn("agrees", F.coalesce(F.col("_item_y") == F.col(label), F.lit(False))).drop("_item_y")


def crop_boxes(items: DataFrame, geometry: DataFrame, default: tuple[float, float, float, float] = (1.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """Crop box in even pixels from per-subject fractions, with a default.

    ``geometry`` has subject, width_frac, x_frac, height_frac, y_frac.
    """
    names = ("width_frac", "x_frac", "height_frac", "y_frac")
    j = items.join(geometry.select("subject", *names), "subject", "left")
    frac = lambda i: F.coalesce(F.col(names[i]), F.lit(default[i]))
    even = lambda size, f: (F.floor(F.col(size) * f / 2) * 2).cast("int")
    return j.select(
        *items.columns, even("width", frac(1)).alias("crop_x"), even("height", frac(3)).alias("crop_y"),
        even("width", frac(0)).alias("crop_w"), even("height", frac(2)).alias("crop_h"),
    )
