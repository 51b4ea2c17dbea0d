"""Manifests, stores and sinks: files in, tables and logs out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from chronoline.functions.paths import base_name
from chronoline.operators.blocks import BLK, Run, carry_over
from chronoline.session import settle


def read_manifest(spark: SparkSession, root: str, glob: str | None = None, depth: int | None = None) -> DataFrame:
    """Every file below a root: path, length, modification time; content is never read.

    ``depth`` is the number of folders between the root and a file, at most; no bound if not given.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).select("path", "length", F.col("modificationTime").alias("modified")).dropDuplicates(["path"])
    if depth is None:
        return files
    below = F.regexp_replace(F.substring_index("path", root.rstrip("/").rsplit(":", 1)[-1].rstrip("/") + "/", -1), r"/+", "/")
    return files.filter(F.size(F.split(below, "/")) - 1 <= depth)


def read_windows(spark: SparkSession, path: str, optional: Sequence[str] = ("clip_path",)) -> DataFrame:
    """Window store; optional columns absent from old files come back as null."""
    return with_optional(spark.read.option("mergeSchema", True).parquet(path), optional)


def read_predictions(spark: SparkSession, path: str, optional: Sequence[str] = ("path", "sub", "idx")) -> DataFrame:
    """Prediction store partitioned by run_id; optional columns tolerated."""
    return with_optional(spark.read.option("mergeSchema", True).parquet(path), optional)


def with_optional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast("string").alias(n) for n in names if n not in df.columns])


def read_results(spark: SparkSession, path: str, class_names: Sequence[str]) -> DataFrame:
    """Nested run results; per-class structs become a map."""
    raw = spark.read.option("multiLine", True).json(path)
    pairs = []
    for c in class_names:
        pairs += [F.lit(c), F.col(f"per_class.`{c}`")]
    return raw.withColumn("per_class", F.create_map(*pairs)).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def number_rows(df: DataFrame, order: Sequence[str], out: str = "clip_id") -> DataFrame:
    """Dense number from 0 in a global order of any type, such as clip paths.

    Rows are range-partitioned and settled once; the partition is the block, so no
    task sorts more than its share.
    """
    placed = settle(df.repartitionByRange(*order).withColumn(BLK, F.spark_partition_id().cast("bigint")))
    sizes = placed.groupBy(BLK).agg(F.count(F.lit(1)).alias("_s_before"))
    before = carry_over(sizes, [], [Run("before", "sum", F.lit(1), "before")])
    local = placed.withColumn("_n", F.row_number().over(W.partitionBy(BLK).orderBy(*order)))
    return local.join(before, BLK, "left").select(
        *df.columns, (F.col("_n") - 1 + F.coalesce("_c_before", F.lit(0))).cast("bigint").alias(out)
    )


def write_windows(windows: DataFrame, path: str, clip: str = "clip_path", parts: int | None = None) -> None:
    """Window store ordered by clip, with ids that do not depend on arrival."""
    ids = number_rows(windows.select(clip).distinct(), [clip])
    out = windows.join(ids, clip)
    ranged = out.repartitionByRange(parts, "clip_id") if parts else out.repartitionByRange("clip_id")
    ranged.sortWithinPartitions("clip_id", "w_idx").write.mode("overwrite").parquet(path)


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each group in a declared order (O03); Spark limits before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")


def middle_row(df: DataFrame, key: str, order: str) -> DataFrame:
    """The middle row of each group's sorted list, without sorting a group in one task."""
    placed = settle(number_rows(df, [key, order], "_i"))
    span = placed.groupBy(key).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    hit = F.col("_i") == F.col("_first") + F.floor(F.col("_n") / 2)
    return placed.join(span, key).filter(hit).select(*df.columns)


def write_log(log: DataFrame, path: str) -> None:
    """Event or background clip log as CSV with a header."""
    log.write.mode("overwrite").option("header", True).csv(path)


def session_documents(scores: DataFrame, qc: DataFrame, key: str = "session") -> DataFrame:
    """One nested document per session: input counts and sweep rows.

    The sweep has one row per modality and threshold, which bounds the document.
    Annotations, events and traces have no such bound and stay tables.
    """
    inner = lambda df: F.struct(*[c for c in df.columns if c != key])
    sweep = scores.groupBy(key).agg(F.array_sort(F.collect_list(inner(scores))).alias("sweep"))
    return qc.select(key, inner(qc).alias("qc")).join(sweep, key, "left")


def write_session_results(docs: DataFrame, trace: DataFrame, events: DataFrame, annotations: DataFrame, path: str) -> None:
    """Documents as JSON lines; trace, events and annotations as Parquet beside them."""
    docs.write.mode("overwrite").json(f"{path}/documents")
    trace.write.mode("overwrite").partitionBy("session", "modality").parquet(f"{path}/trace")
    events.write.mode("overwrite").partitionBy("session").parquet(f"{path}/events")
    annotations.write.mode("overwrite").partitionBy("session").parquet(f"{path}/annotations")


def pending(sessions: DataFrame, done: DataFrame, key: str = "session") -> DataFrame:
    """Sessions the log does not have yet."""
    return sessions.join(done.select(key), key, "left_anti")


def append_log(rows: DataFrame, path: str, key: str = "session", batch: int | str | None = None) -> None:
    """Append rows whose key the log does not have, once however often the job is run.

    A batch owns the folder ``batch=<id>``, which is its entry in the ledger: a batch that is run again
    replaces what it wrote, and keys that other batches have logged are left out by an anti-join. Of
    rows with one key one is kept. Without an id, the batch is named by its keys.
    """
    spark = rows.sparkSession
    rows = settle(rows.dropDuplicates([key]))
    if batch is None:
        batch = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("h")).select(
            F.concat(F.lit("k"), F.hex(F.xxhash64("n", "h")))).first()[0]
    own = f"{path}/batch={batch}"
    old = read_log(spark, path)
    if old is not None:
        others = old.filter(F.col("batch") != F.lit(str(batch))).select(key).distinct()
        rows = settle(rows.join(others, key, "left_anti"))
    rows.write.mode("overwrite").parquet(own)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The log's rows with the batch each came with, or None if there is no log yet.

    Only batches that ended count: their folders carry Spark's success mark.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS"))
    folders = [f.getPath().getParent().toString() for f in done or []]
    if not folders:
        return None
    found = spark.read.option("basePath", path).parquet(*folders)
    return found.withColumn("batch", F.col("batch").cast("string"))


def log_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "session") -> None:
    """Log a stream's new keys, all that is available now; a stream replayed from its start logs nothing twice."""
    sink = stream.writeStream.foreachBatch(lambda rows, number: append_log(rows, path, key, number)).option("checkpointLocation", checkpoint)
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def skip_existing(wanted: DataFrame, outputs: DataFrame, key: str = "path") -> DataFrame:
    """Outputs still to be made; the others report ``exists``."""
    have = outputs.select(key, F.lit(True).alias("_have")).dropDuplicates([key])
    return wanted.join(have, key, "left").withColumn("status", F.when(F.col("_have"), "exists").otherwise("to_do")).drop("_have")


def find_source(wanted: DataFrame, archive: DataFrame, name: str = "name", subject: str = "subject") -> DataFrame:
    """First archive file of that name by root, then layout.

    ``archive`` has root_ord, path and layout (0 under the subject, 1 in a dated folder,
    2 at the root). A file filed under another subject is not a match for layout 0. The
    archive shrinks to its best file per name, and per name and folder for layout 0, before
    any join, so a name with very many copies pairs with nothing.
    """
    files = archive.select(base_name(F.col("path")).alias(name), F.struct("root_ord", "layout", "path").alias("_f"))
    shared = files.filter(F.col("_f.layout") != 0).groupBy(name).agg(F.min("_f").alias("_shared"))
    folders = F.array_distinct(F.slice(F.split("_f.path", "/"), 1, F.size(F.split("_f.path", "/")) - 1))
    own = files.filter(F.col("_f.layout") == 0).select(name, "_f", F.explode(folders).alias(subject))
    own = own.groupBy(name, subject).agg(F.min("_f").alias("_own"))
    best = F.array_min(F.filter(F.array("_own", "_shared"), lambda f: f.isNotNull()))
    found = wanted.select(name, subject).distinct().join(shared, name, "left").join(own, [name, subject], "left")
    return found.select(name, subject, best["path"].alias("source_path"))
