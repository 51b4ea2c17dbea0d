"""Event extraction and session intake as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from chronoline.operators.events import THRESHOLDS, threshold_array


def _hits(scores: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    return scores.withColumn("thr", F.explode(F.filter(threshold_array(thresholds), lambda x: x <= F.col("p"))))


def _seconds(c) -> Column:
    return F.unix_micros(c) / F.lit(1e6)


def stream_events(
    scores: DataFrame, thresholds: Sequence[float] = THRESHOLDS, win: float = 4.0, min_dur: float = 4.0, merge_gap: float = 4.0,
    watermark: str = "1 minute", keys: Sequence[str] = ("session", "modality"), ts: str = "ts",
) -> DataFrame:
    """Closed events of a score stream with columns keys, ts (timestamp) and p.

    Session windows join hits whose distance is at most the gap, as the batch operator
    does. Rows later than the watermark are dropped. Events that the watermark has not
    closed when a source ends are still in the stream's state: :func:`open_events`.
    """
    gap = f"{int(round((win + merge_gap) * 1e6))} microseconds"
    hits = _hits(scores.withWatermark(ts, watermark), thresholds)
    events = hits.groupBy(*keys, "thr", F.session_window(ts, gap)).agg(
        _seconds(F.min(ts)).alias("t_start"), (_seconds(F.max(ts)) + F.lit(win)).alias("t_end"), F.max("p").alias("peak"), F.count(F.lit(1)).alias("n_hits")
    )
    return events.filter(F.col("t_end") - F.col("t_start") >= F.lit(min_dur)).select(*keys, "thr", "t_start", "t_end", "peak", "n_hits")


def open_events(spark: SparkSession, checkpoint: str, like: DataFrame, win: float = 4.0, min_dur: float = 4.0, keys: Sequence[str] = ("session", "modality")) -> DataFrame:
    """Events still open where a stopped stream of :func:`stream_events` ended, from its own state.

    The source is not read again: the state holds one row for each open window, with the first and the
    last hit, the peak and the count. ``like`` is the stream, for its columns. A stream that has
    not committed a batch has none.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/[0-9]*")):
        return spark.createDataFrame([], like.schema)
    held = spark.read.format("statestore").load(checkpoint)
    names = [*keys, "thr", "_window", "_first", "_last", "peak", "n_hits"]  # the state's fields, in the order of the aggregates
    fields = held.schema["value"].dataType.fields
    value = F.col("value").cast(T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)]))
    events = held.select(value.alias("_v")).select("_v.*").withColumn("t_start", _seconds(F.col("_first"))).withColumn("t_end", _seconds(F.col("_last")) + F.lit(win))
    return events.filter(F.col("t_end") - F.col("t_start") >= F.lit(min_dur)).select(*keys, "thr", "t_start", "t_end", "peak", "n_hits")


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything available once and append it to a Parquet folder."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def new_sessions(manifest: DataFrame, key: str = "session_key") -> DataFrame:
    """Each session of a manifest stream once; the checkpoint takes the log's place."""
    return manifest.select(key).dropDuplicates([key])
