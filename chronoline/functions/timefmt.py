"""Clock and file-name expressions: start times, formatted seconds, clip names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def name_timestamp(name: Column) -> Column:
    """Fourteen-digit, then twelve-digit stamp in a file name; impossible dates fall through."""
    return F.coalesce(
        F.try_to_timestamp(F.regexp_extract(name, r"(\d{14})", 1), F.lit("yyyyMMddHHmmss")),
        F.try_to_timestamp(F.regexp_extract(name, r"(\d{12})", 1), F.lit("yyyyMMddHHmm")),
    ).cast("timestamp_ntz")


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(
        F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")
    ).cast("timestamp_ntz")


def edf_name_date(name: Column, year: int) -> Column:
    """Date in a signal file's name: a range's first day, a single day, or eight digits."""
    spans = r"\((\d{1,2})-(\d{1,2})\s+to\s+\d{1,2}-\d{1,2}\)"
    single = r"\((\d{1,2})-(\d{1,2})\)"
    full = r"(\d{4})(\d{2})(\d{2})"
    g = lambda p, i: F.regexp_extract(name, p, i)
    return F.coalesce(
        _day(F.lit(str(year)), g(spans, 1), g(spans, 2)),
        _day(F.lit(str(year)), g(single, 1), g(single, 2)),
        _day(g(full, 1), g(full, 2), g(full, 3)),
    )


def flexible_timestamp(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with or without a fraction, else null."""
    whole = F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?)$", 1)
    return F.nullif(whole, F.lit("")).try_cast("timestamp_ntz")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, microsecond exact."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def hms(seconds: Column) -> Column:
    """Seconds as HH:MM:SS, truncated, never below zero."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0).cast("bigint"))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("string")
    wide = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.concat_ws(":", wide, two(F.floor((s % 3600) / 60)), two(s % 60))


def safe_label(label: Column) -> Column:
    return F.regexp_replace(label, r"\W", "_")


def padded_index(idx: Column) -> Column:
    text = idx.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def clip_name(idx: Column, label: Column, t_start: Column, prefix: str = "seizure_") -> Column:
    """``<prefix><idx>_<label>_<yyyyMMdd_HHmmss>``."""
    stamp = F.date_format(F.timestamp_seconds(F.floor(t_start)), "yyyyMMdd_HHmmss")
    return F.concat(F.lit(prefix), padded_index(idx), F.lit("_"), safe_label(label), F.lit("_"), stamp)
