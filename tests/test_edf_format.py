import struct

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from chronoline.sources import edf, edf_format
from tests.test_signal import write_edf

START = 1706756645.0


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("edf")
    (where / "deep").mkdir()
    a = [((i * 37) % 60000) - 30000 for i in range(1000)]
    write_edf(where / "one.edf", b"01.02.2403.04.05", [("EEG L", -2, 2, a), ("ECG", 0, 1, list(range(1000)))], 100, 10)
    write_edf(where / "deep" / "two.EDF", b"xx.02.24xx.04.05", [("EEG R", -1, 1, a)], 7, 10)
    write_edf(where / "open.edf", b"01.02.2403.04.05", [("EEG L", -2, 2, a)], 20, 10)
    raw = (where / "open.edf").read_bytes()
    (where / "open.edf").write_bytes(raw[:236] + b"-1      " + raw[244:-5])  # still recorded: no count, the last record cut
    (where / "note.txt").write_text("no signal")
    return where


def samples(rows, file, label):
    own = sorted((r for r in rows if r["path"].endswith(file) and r["label"] == label), key=lambda r: r["block_id"])
    return np.concatenate([r["samples"] for r in own]), [r["t0"] for r in own]


@pytest.mark.parametrize("split", [100, 777, 1 << 26])
def test_blocks_of_every_file_whatever_the_splits(spark, folder, split):
    rows = edf_format.register(spark).read.format("edf").option("records", 8).option("split_bytes", split).load(str(folder)).collect()
    x, t0 = samples(rows, "one.edf", "EEG L")
    a = np.array([((i * 37) % 60000) - 30000 for i in range(1000)])
    assert np.allclose(x, (a + 32768) * (4 / 65535) - 2, atol=1e-5) and t0 == [START + 8 * k for k in range(13)]
    y, t0 = samples(rows, "two.EDF", "EEG R")
    assert len(y) == 70 and t0 == [None]
    assert len(samples(rows, "open.edf", "EEG L")[0]) == 190
    heads = edf.read_headers(spark, str(folder)).where("path like '%one.edf'")
    want = {(r["ordinal"], r["block_id"]): (r["t0"], r["samples"]) for r in edf.read_signals(heads, 8).collect()}
    assert want == {(r["ordinal"], r["block_id"]): (r["t0"], r["samples"]) for r in rows if r["path"].endswith("one.edf")}


def test_filters_narrow_what_is_read(spark, folder, monkeypatch):
    read = {"bytes": 0, "files": set()}
    plain = edf_format._open

    class Counted:
        def __init__(self, path):
            self.file = plain(path)
            read["files"].add(path.rsplit("/", 1)[-1])

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            read["bytes"] += n
            return self.file.read(n)

    monkeypatch.setattr(edf_format, "_open", Counted)

    def rows(*filters, split=1 << 26):
        read.update(bytes=0, files=set())
        r = edf_format.EdfReader(str(folder), 5, split)
        assert list(r.pushFilters(list(filters))) == list(filters)  # Spark applies them again
        return [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]

    everything, whole = rows(), read["bytes"]
    assert whole > 4000 and len(read["files"]) == 3
    part = rows(EqualTo(("label",), "ECG"), GreaterThanOrEqual(("t0",), START + 50), LessThan(("t0",), START + 60))
    assert [(r["label"], r["t0"]) for r in part] == [("ECG", START + 50), ("ECG", START + 55)]
    assert read["bytes"] == 768 + 3 * 0 + 2 * 5 * 40 + 2 * 512  # three headers, two blocks of five records
    one = rows(EqualTo(("path",), next(r["path"] for r in everything if r["path"].endswith("one.edf"))), LessThan(("block_id",), 1))
    assert len(one) == 2 and read["files"] == {"one.edf"}
    assert rows(EqualTo(("t0",), START + 1)) == []


def test_filters_reach_the_source(spark, folder):
    df = edf_format.register(spark).read.format("edf").load(str(folder)).where("label = 'ECG' and t0 >= 1706756646 and length(path) > 1")
    assert df.count() == 1 and df.first()["block_id"] == 1
    with pytest.raises(Exception, match="positive"):
        spark.read.format("edf").option("records", 0).load(str(folder)).collect()


def test_written_files_are_read_again(spark, tmp_path):
    source = tmp_path / "a.edf"
    write_edf(source, b"01.02.2403.04.05", [("EEG L", -1, 1, list(range(50)))], 5, 10)
    files = spark.createDataFrame([("x/one.edf", bytearray(source.read_bytes())), ("two.edf", bytearray(source.read_bytes()))], "path string, content binary")
    for _ in range(2):  # a second run leaves the same files
        assert edf.write_files(files, str(tmp_path / "out")).count() == 2
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["one.edf", "two.edf"]
    assert struct.unpack("<h", (tmp_path / "out" / "two.edf").read_bytes()[-2:]) == (49,)
    rows = edf_format.register(spark).read.format("edf").load(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and len(rows[0]["samples"]) == 50


def test_small_files_share_partitions(spark, tmp_path):
    for k in range(300):
        write_edf(tmp_path / f"{k:03}.edf", b"01.02.2403.04.05", [("EEG L", -1, 1, list(range(k, k + 50)))], 5, 10)
    parts = edf_format.EdfReader(str(tmp_path), 2, 1 << 26).partitions()
    assert [len(p.ranges) for p in parts] == [256, 44]
    assert len(edf_format.EdfReader(str(tmp_path), 2, 1 << 9).partitions()) > 300  # files beyond the split size are still cut
    rows = edf_format.register(spark).read.format("edf").option("records", 2).load(str(tmp_path)).collect()
    assert len({r["path"] for r in rows}) == 300 and len(rows) == 900
