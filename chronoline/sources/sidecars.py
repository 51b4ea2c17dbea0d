"""Sidecar text: key-value notes, start-time XML, build logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoline.functions.numbers import let
from chronoline.functions.timefmt import edf_name_date, epoch, flexible_timestamp, name_timestamp


def key_values(body: Column) -> Column:
    """``key : value`` lines as a map, split on the first colon, last line wins."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, 1 << 30)).alias("v")
    ))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    return let(pairs, lambda ps: F.map_from_entries(last(ps)))


def note_fields(notes: DataFrame, body: str = "body") -> DataFrame:
    """Typed columns of an event note."""
    kv = notes.withColumn("_kv", key_values(F.col(body)))
    get = lambda k: F.try_element_at(F.col("_kv"), F.lit(k))
    return kv.withColumn("label", get("Label")).withColumn("duration", get("Duration (s)").try_cast("double")).withColumn(
        "pre_buffer", get("Pre-buffer (s)").try_cast("double")
    ).withColumn("clip_start", get("Clip start")).withColumn("event_start", get("Seizure start")).withColumn(
        "event_end", get("Seizure end")
    ).drop("_kv")


def event_offsets(fields: DataFrame) -> DataFrame:
    """Event start and end inside its clip: from three stamps, else from buffer and duration."""
    c, s, e = (epoch(flexible_timestamp(F.col(x))) for x in ("clip_start", "event_start", "event_end"))
    stamped = c.isNotNull() & s.isNotNull() & e.isNotNull()
    return fields.withColumn("rel_start", F.when(stamped, s - c).otherwise(F.when(F.col("duration").isNotNull(), F.col("pre_buffer")))).withColumn(
        "rel_end", F.when(stamped, e - c).otherwise(F.col("pre_buffer") + F.col("duration"))
    )


def xml_start(doc: Column) -> Column:
    """Start time in a recorder's sidecar XML, null when absent or broken."""
    text = F.regexp_extract(doc, r"<DSI_utc_start_time[^>]*>\s*(\d+)\s*</DSI_utc_start_time>", 1)
    return F.nullif(text, F.lit("")).try_cast("bigint")


def read_xml_starts(spark, path: str) -> DataFrame:
    """``stem, start_s`` of every sidecar under a folder; .XML is preferred to .xml."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{XML,xml}").text(path, wholetext=True)
    docs = docs.select(F.col("_metadata.file_path").alias("path"), xml_start(F.col("value")).alias("start_s"))
    pick = F.struct(F.when(F.col("path").endswith(".XML"), 0).otherwise(1), F.col("path"))
    return docs.groupBy(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem_path")).agg(F.min_by("start_s", pick).alias("start_s"))


def read_notes(spark, path: str) -> DataFrame:
    """All ``info.txt`` notes under a folder as (clip, body)."""
    docs = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "info.txt").text(path, wholetext=True)
    return docs.select(F.regexp_replace("_metadata.file_path", r"/info\.txt$", "").alias("clip"), F.col("value").alias("body"))


def start_time(files: DataFrame, xml_s: str = "xml_s", header_s: str = "header_s", name: str = "name", year: int = 2022, strict: bool = True) -> DataFrame:
    """Start with its provenance: XML, then header, then name; strict never trusts a name.

    Files without a trusted start keep a null start and source ``none``, to be counted
    as rejected.
    """
    named = F.coalesce(epoch(name_timestamp(F.col(name))), epoch(edf_name_date(F.col(name), year)))
    named = F.lit(None).cast("double") if strict else named
    xml, header = F.col(xml_s).cast("double"), F.col(header_s).cast("double")
    src = F.when(xml.isNotNull(), "xml").when(header.isNotNull(), "header").when(named.isNotNull(), "filename").otherwise("none")
    return files.withColumn("start_s", F.coalesce(xml, header, named)).withColumn("source", src)


def build_parameters(line: Column) -> Column:
    """win, stride and decim out of a build log line."""
    g = lambda k: F.regexp_extract(line, k + r"=([0-9.]+)", 1).try_cast("double")
    return F.struct(g("win").alias("win"), g("stride").alias("stride"), g("decim").alias("decim"))
