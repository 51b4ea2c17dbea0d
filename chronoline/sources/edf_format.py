"""``spark.read.format("edf")``: folders of EDF files as signal blocks.

    register(spark)
    spark.read.format("edf").load(folder).where("label = 'EEG L' AND t0 >= 1706756645")

Rows are those of ``edf.read_signals``: path, ordinal, label, sfreq, block_id, t0, samples, one for
each channel and each ``records`` data records. A partition is a range of bytes of one file, or several
small files: planning lists names and sizes only, and the task that holds a block's first byte reads it. Filters on path drop
partitions, on label channels, and on t0 and block_id the ranges that are read at all.

Options: ``records`` in a block (60), ``split_bytes`` of a partition (64 MB).
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith,
)

from chronoline.sources.edf import BLOCKS, _frame, _open, HEADER, block_rows, file_system, header_rows

_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: A file counts as so many bytes at least when small ones share a partition, and so many share one at most.
OPEN_BYTES, MOST_FILES = 1 << 18, 256
_TEXT = {EqualTo: operator.eq, In: lambda x, v: x in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith}


@dataclass
class Piece(InputPartition):
    """Of each file, the blocks that begin in a range of its bytes: (path, low, high, size)."""

    ranges: list[tuple[str, int, int, int]]

    def __post_init__(self):
        super().__init__(self.ranges[0][0])


class EdfReader(DataSourceReader):
    def __init__(self, path: str, records: int, split_bytes: int):
        self.path, self.records, self.split_bytes = path, records, split_bytes
        self.rules: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Remember what narrows the reads; Spark applies all filters to the rows as well."""
        for f in filters:
            name = getattr(f, "attribute", ("",))
            if len(name) == 1 and (type(f) in _TEXT and name[0] in ("path", "label") or type(f) in _COMPARE and name[0] in ("t0", "block_id")):
                self.rules.append((name[0], type(f), f.value))
            yield f

    def _text_fits(self, name: str, value: str) -> bool:
        return all(_TEXT[kind](value, x) for n, kind, x in self.rules if n == name)

    def partitions(self) -> list[Piece]:
        from pyarrow import fs

        system, where, prefix = file_system(self.path)
        info = system.get_file_info(where)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where, recursive=True))
        named = sorted((prefix + f.path, f.size) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".edf"))
        step = self.split_bytes
        out, room = [], 0
        for p, size in named:
            if not self._text_fits("path", p):
                continue
            cost = max(size, OPEN_BYTES)
            if size > step or not out or room < cost or len(out[-1].ranges) == MOST_FILES:
                out += [Piece([(p, lo, lo + step, size)]) for lo in range(0, max(size, 1), step)]
                room = 0 if size > step else step - cost
            else:
                out[-1].ranges.append((p, 0, step, size))
                room -= cost
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for path, low, high, size in partition.ranges:
            yield from self._read(path, low, high, size)

    def _read(self, path: str, low: int, high: int, size: int) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            head = f.read(256)
            rows = header_rows(path, head + f.read(256 * int(head[252:256])))
            channels = _frame(rows, HEADER)
            channels = channels[[self._text_fits("label", x) for x in channels["label"]]]
            if not len(channels):
                return
            first = channels.iloc[0]
            begin, wide = int(first["header_bytes"]), int(first["record_bytes"])
            whole = max(0, (size - begin) // wide)  # the header may not know, and the last record may be cut
            n_records = whole if first["n_records"] < 0 else min(int(first["n_records"]), whole)
            block = wide * self.records
            every = -(-n_records // self.records)
            begins = max(0, -(-(low - begin) // block))
            ends = min(every, max(0, -(-(high - begin) // block)))
            ids = np.arange(begins, ends)
            start = None if first["start_s"] is None or np.isnan(first["start_s"]) else float(first["start_s"])
            for name, kind, value in self.rules:
                if name == "t0":
                    ids = ids[:0] if start is None else ids[_COMPARE[kind](start + ids * self.records * first["record_s"], float(value))]
                elif name == "block_id":
                    ids = ids[_COMPARE[kind](ids, value)]
            for b in ids.tolist():
                n = min(self.records, n_records - b * self.records)
                f.seek(begin + b * block)
                own = channels.assign(block_id=b, t0=np.nan if start is None else start + b * self.records * first["record_s"])
                yield _batch(block_rows(own, f.read(n * wide), n))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
    columns = list(zip(*rows))
    columns[5] = [None if np.isnan(t) else t for t in columns[5]]
    names = [f.strip().split(" ")[0] for f in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> EdfReader:
        records, split = int(self.options.get("records", 60)), int(self.options.get("split_bytes", 1 << 26))
        if records < 1 or split < 1:
            raise ValueError("records and split_bytes must be positive")
        return EdfReader(self.options["path"], records, split)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)
    return spark
