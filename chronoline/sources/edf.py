"""EDF ingest: headers by a short read, samples by record ranges.

Files are listed by Spark without their content. Tasks then read only the bytes
they need: the header, or a range of data records. A long file becomes many tasks,
and no task or driver ever holds a whole one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

HEADER = (
    "path string, start_s double, n_records bigint, record_s double, n_ch int, header_bytes int, record_bytes int, "
    "ordinal int, label string, sfreq double, per_record int, offset int, lo double, hi double, dig_lo double, dig_hi double"
)
BLOCKS = "path string, ordinal int, label string, sfreq double, block_id bigint, t0 double, samples array<double>"


def header_rows(path: str, raw: bytes) -> list[tuple]:
    """One row per channel from the bytes of a header; fields as the public EDF layout has them."""
    text = lambda a, n: raw[a:a + n].decode("latin-1").strip()
    n_ch = int(text(252, 4))
    try:
        start = dt.datetime.strptime(text(168, 8) + " " + text(176, 8), "%d.%m.%y %H.%M.%S")
        start_s = (start - dt.datetime(1970, 1, 1)).total_seconds()
    except ValueError:
        start_s = None
    record_s, n_records = float(text(244, 8)), int(text(236, 8))
    col = lambda skip, width: [text(256 + skip * n_ch + width * i, width) for i in range(n_ch)]
    labels, lo, hi = col(0, 16), col(104, 8), col(112, 8)
    dlo, dhi, per = col(120, 8), col(128, 8), [int(x) for x in col(216, 8)]
    rows, offset = [], 0
    for i in range(n_ch):
        rows.append((path, start_s, n_records, record_s, n_ch, 256 * (n_ch + 1), 2 * sum(per), i, labels[i], per[i] / record_s, per[i],
                     offset, float(lo[i]), float(hi[i]), float(dlo[i]), float(dhi[i])))
        offset += 2 * per[i]
    return rows


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(", ")]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_names(schema))


def file_system(path: str):
    """(file system, path on it, what to put before its paths) of a path as Spark writes it."""
    from pyarrow import fs

    for scheme in ("s3a://", "s3n://"):  # Spark's names of the store
        if path.startswith(scheme):
            path = "s3://" + path[len(scheme):]
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/"), "file:"
    system, where = fs.FileSystem.from_uri(path)
    return system, where, path[: len(path) - len(where.rstrip("/"))] if path.rstrip("/").endswith(where.rstrip("/")) else ""


def _open(path: str):
    system, where, _ = file_system(path)
    return system.open_input_file(where)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (path, content) rows as files under a folder that all executors share; gives the paths written.

    Each file is written beside its place and then moved there, so a task that is run again, or
    twice, leaves the same files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        system, where, prefix = file_system(folder)
        for b in batches:
            done = []
            for p, raw in zip(b["path"], b["content"]):
                target = f"{where}/{p}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                beside = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as f:
                    f.write(bytes(raw))
                system.move(beside, target)
                done.append(prefix + target)
            yield pd.DataFrame({"path": done})

    return files.select("path", "content").mapInPandas(write, "path string")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Channel rows of every EDF file under a folder, from header bytes only."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{edf,EDF}")
        .load(path).select("path")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                with _open(p) as f:
                    head = f.read(256)
                    rows += header_rows(p, head + f.read(256 * int(head[252:256])))
            yield _frame(rows, HEADER)

    return files.mapInPandas(read, HEADER)


def scale(raw: np.ndarray, lo: float, hi: float, dig_lo: float, dig_hi: float) -> np.ndarray:
    """Digital to physical units with the channel's own range."""
    return (raw.astype(np.float64) - dig_lo) * ((hi - lo) / (dig_hi - dig_lo)) + lo


def read_signals(headers: DataFrame, records_per_block: int = 60, t_min: float | None = None, t_max: float | None = None) -> DataFrame:
    """Signal blocks of the given channels; each row of work is one record range.

    ``t_min`` / ``t_max`` are absolute seconds: ranges outside are never read.
    """
    step = records_per_block
    work = headers.withColumn("block_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_records") - 1) / step))))
    t0 = F.col("start_s") + F.col("block_id") * step * F.col("record_s")
    work = work.withColumn("t0", t0)
    if t_min is not None:
        work = work.filter(F.col("t0") + F.lit(step) * F.col("record_s") > t_min)
    if t_max is not None:
        work = work.filter(F.col("t0") < t_max)
    work = work.repartition("path", "block_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (p, blk), g in b.groupby(["path", "block_id"]):
                first = g.iloc[0]
                n = int(min(step, first["n_records"] - blk * step))
                with _open(p) as f:
                    f.seek(int(first["header_bytes"] + blk * step * first["record_bytes"]))
                    raw = f.read(int(n * first["record_bytes"]))
                yield _frame(block_rows(g, raw, n), BLOCKS)

    return work.mapInPandas(read, BLOCKS)


def block_rows(channels: pd.DataFrame, raw: bytes, n: int) -> list[tuple]:
    rows = []
    for c in channels.itertuples():
        words = np.frombuffer(raw, dtype="<i2").reshape(n, c.record_bytes // 2)
        x = words[:, c.offset // 2:c.offset // 2 + c.per_record].reshape(-1)
        y = scale(x, c.lo, c.hi, c.dig_lo, c.dig_hi)
        rows.append((c.path, int(c.ordinal), c.label, float(c.sfreq), int(c.block_id), float(c.t0), y))
    return rows


def decode_content(files: DataFrame) -> DataFrame:
    """Signal blocks of small files already held as (path, content), such as event clips."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"]):
                raw = bytes(raw)
                head = _frame(header_rows(p, raw), HEADER)
                head["block_id"], head["t0"] = 0, head["start_s"]
                n = int(head["n_records"].iloc[0])
                first = int(head["header_bytes"].iloc[0])
                yield _frame(block_rows(head, raw[first:first + n * int(head["record_bytes"].iloc[0])], n), BLOCKS)

    return files.select("path", "content").mapInPandas(read, BLOCKS)
