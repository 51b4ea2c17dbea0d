"""Annotation sheets with free-form headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from chronoline.functions.timefmt import flexible_timestamp
from chronoline.session import settle

# fixed values: header fragments that name a field, best first
HEADER_ALIASES = {
    "label": ("label", "stage", "type"), "duration": ("dur", "length"), "start": ("start",), "end": ("end",), "spikes": ("spike",),
}
DEFAULT_LABEL, DEFAULT_DURATION = "Unknown", 30.0


def resolve_headers(columns: list[str]) -> dict[str, str | None]:
    """The first column whose lower-case name contains the first alias that occurs at all."""
    low = [(c, c.strip().lower()) for c in columns]
    found: dict[str, str | None] = {}
    for name, aliases in HEADER_ALIASES.items():
        found[name] = next((c for a in aliases for c, n in low if a in n), None)
    return found


def parse_start(text: Column, day: Column | None) -> Column:
    """Full stamps as they are; bare ``HH:MM:SS`` on the session's day when that is known."""
    full = flexible_timestamp(text)
    if day is None:
        return full
    clock = F.nullif(F.regexp_extract(text, r"^(\d{1,2}:\d{2}:\d{2})$", 1), F.lit(""))
    return F.coalesce(full, flexible_timestamp(F.concat_ws(" ", day.cast("string"), clock)))


def normalise_sheet(sheet: DataFrame, day: str | None = None, order: str | None = None) -> DataFrame:
    """Typed annotations; rows that are none keep a null start and say why.

    A unit row ("[s]" under a header) has no parsable start. Missing labels become
    "Unknown", missing or non-numeric durations 30 s, and a missing end is start plus
    duration. ``reason`` is ok, no_start, no_day (a bare clock without its day) or unit_row.
    """
    cols = resolve_headers([c for c in sheet.columns if c not in (day, order)])
    if cols["start"] is None:
        raise ValueError(f"no start column among {sheet.columns}")
    get = lambda k: F.col(f"`{cols[k]}`") if cols[k] else F.lit(None).cast("string")
    d = F.col(day) if day else None
    raw = F.trim(get("start").cast("string"))
    start, end = parse_start(raw, d), parse_start(F.trim(get("end").cast("string")), d)
    duration = F.coalesce(F.trim(get("duration").cast("string")).try_cast("double"), F.lit(DEFAULT_DURATION))
    span = F.make_dt_interval(secs=duration.cast("decimal(18,6)"))
    keep = [c for c in sheet.columns if c not in [v for v in cols.values() if v]]
    return sheet.select(
        *[F.col(f"`{c}`") for c in keep],
        F.coalesce(F.nullif(F.trim(get("label").cast("string")), F.lit("")), F.lit(DEFAULT_LABEL)).alias("label"),
        duration.alias("duration"), start.alias("start"), F.coalesce(end, start + span).alias("end"),
        F.coalesce(get("spikes").cast("string").try_cast("int"), F.lit(0)).alias("spikes"),
        F.when(raw.isNull() | (raw == ""), "no_start").when(start.isNull() & raw.rlike(r"^\d{1,2}:\d{2}:\d{2}$"), "no_day").when(start.isNull(), "unit_row").otherwise("ok").alias("reason"),
    )


def number_rows(raw: DataFrame, out: str = "idx") -> DataFrame:
    """Add each row's number in its file, from 1, to rows read from files in splits.

    A split is read in order by one task, so rows are numbered inside it as they come, and by the rows of the
    splits before it: one count for each split, whatever the size of a file. ``raw`` must be read from files.
    """
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_m"))
    placed = settle(placed)
    splits = placed.groupBy("_file", "_at").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = placed.join(starts, ["_file", "_at"])
    return joined.select(*raw.columns, (F.col("_m") - F.col("_first") + F.col("_before") + 1).alias(out))


def read_sheet(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """A sheet exported as CSV, every cell as text until its field is known; ``idx`` is the row below the header."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return normalise_sheet(number_rows(raw), day, order="idx")
