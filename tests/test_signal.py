"""Signals, features and EDF ingest."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoline.functions.numbers import nearest_available, sample_indices
from chronoline.functions.paths import unique_labels
from chronoline.operators import features as ft, ml, signal as sg
from chronoline.sources import edf

SIG = "session int, block_id bigint, samples array<float>"


def blocks_of(x, n, session=1):
    return [(session, i // n, [float(v) for v in x[i:i + n]]) for i in range(0, len(x), n)]


@pytest.mark.parametrize("win,stride", [(5, 5), (10, 3), (23, 4), (8, 8)])
def test_sliding_windows_equal_slices(spark, win, stride):
    x = np.arange(61, dtype=float)
    df = spark.createDataFrame(blocks_of(x, 8), SIG)
    got = {r["start"]: list(r["samples"]) for r in sg.sliding_windows(df, win, stride, 8).collect()}
    assert got == {s: list(x[s:s + win]) for s in range(0, 61 - win + 1, stride)}


def test_windows_across_a_gap_are_dropped(spark):
    x = np.arange(40, dtype=float)
    df = spark.createDataFrame([b for b in blocks_of(x, 8) if b[1] != 2], SIG)
    starts = sorted(r["start"] for r in sg.sliding_windows(df, 10, 2, 8).collect())
    assert starts == [s for s in range(0, 31, 2) if not (s < 24 and s + 10 > 16)]


def test_decimation_equals_one_pass_over_the_whole_signal(spark):
    x = np.random.default_rng(0).normal(size=500)
    df = spark.createDataFrame(blocks_of(x, 50), SIG)
    rows = sg.decimate(df, 4, 50).orderBy("block_id").collect()
    got = np.concatenate([r["samples"] for r in rows])
    want = np.convolve(x.astype(np.float32), sg.low_pass(4), mode="same")[::4]
    assert np.allclose(got, want, atol=1e-5)
    assert [r["first"] for r in rows] == [math.ceil(50 * i / 4) for i in range(10)]


def test_constant_window_scores_zero(spark):
    df = spark.createDataFrame([([2.0] * 8,)], "samples array<float>")
    assert sg.normalised(df).collect()[0]["z"] == [0.0] * 8


def test_features_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=(20, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, samples array<float>")
    for r in ft.window_features(df).collect():
        s = x[r["i"]].astype(np.float64)
        d = np.diff(s)
        power, freq = np.abs(np.fft.rfft(s)) ** 2, np.fft.rfftfreq(64, 1 / 125)
        for name, (lo, hi) in zip(ft.BAND_NAMES, ft.BANDS):
            assert r[f"band_{name}"] == pytest.approx(power[(freq >= lo) & (freq < hi)].sum() / (power.sum() + 1e-8))
        assert r["sd"] == pytest.approx(s.std()) and r["rms"] == pytest.approx(np.sqrt((s**2).mean()))
        assert r["line_length"] == pytest.approx(np.abs(d).sum()) and r["activity"] == (np.abs(d) > d.std()).sum()
        assert r["zero_crossings"] == (s[:-1] * s[1:] < 0).sum() and r["range"] == pytest.approx(np.ptp(s))


def test_quality_kinds(spark):
    r = random.Random(2)
    rows = [(1, [1.0] * 200), (2, [float(i % 40) for i in range(200)]), (3, [r.random() for _ in range(200)])]
    q = {x["clip_id"]: x["kind"] for x in sg.signal_quality(spark.createDataFrame(rows, "clip_id int, samples array<double>")).collect()}
    assert q == {1: "flat", 2: "degenerate", 3: "normal"}


def test_beats_of_a_regular_pulse(spark):
    x = [0.1 * math.sin(i) for i in range(1000)]
    for i in range(20, 1000, 20):
        x[i] = 5.0
    df = sg.window_usability(spark.createDataFrame([(1, x)], "subject int, samples array<double>"))
    b = sg.beat_stats(df, 100.0).collect()[0]
    assert b["usable"] and b["rate"] == pytest.approx(5.0) and b["cv"] == pytest.approx(0.0)
    flat = sg.window_usability(spark.createDataFrame([([3.0] * 50,)], "samples array<double>")).collect()[0]
    assert not flat["usable"]


def test_channel_cleaning(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, nan, 3.0, inf, -inf]), (2, [nan, nan]), (3, [2.0, 2.0])]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", sg.clean_channel(F.col("x")).alias("c")).collect()}
    assert got[1]["samples"] == [1.0, 1.0, 3.0, 3.0, 1.0] and (got[1]["lo"], got[1]["hi"]) == (1.0, 3.0)
    assert got[2]["samples"] == [0.0, 0.0] and (got[2]["lo"], got[2]["hi"]) == (-1.0, 1.0)
    assert got[3]["hi"] - got[3]["lo"] == pytest.approx(2e-6)


def test_label_clashes_and_index_sampling(spark):
    labels = ["ECG [FIR-HP: 5Hz]", "ECG [FIR-HP: 5.0Hz]", "EEG"]
    u = spark.createDataFrame([(labels,)], "l array<string>").select(unique_labels(F.col("l")).alias("u")).collect()[0]["u"]
    assert u == ["ECG [FIR-HP: 5Hz", "ECG [FIR-HP: 5.0", "EEG"]
    same = spark.createDataFrame([(["A" * 18, "A" * 17, "A" * 16],)], "l array<string>").select(unique_labels(F.col("l")).alias("u")).collect()[0]["u"]
    assert len(set(same)) == 3 and all(len(x) <= 16 for x in same)
    short = spark.range(1).select(sample_indices(F.lit(5), 16).alias("i"), nearest_available(F.lit(5), F.array(F.lit(4), F.lit(6))).alias("n")).collect()[0]
    assert short["i"] == [0, 1, 2, 3] + [4] * 12 and short["n"] == 4


def write_edf(path, start, channels, n_records, rate):
    """A small EDF file: channels is a list of (label, lo, hi, digital samples)."""
    f = lambda v, w: str(v).ljust(w).encode()
    n = len(channels)
    head = f(0, 8) + f("X", 80) + f("Y", 80) + start + f(256 * (n + 1), 8) + f("", 44) + f(n_records, 8) + f(1, 8) + f(n, 4)
    for width, value in ((16, 0), (80, None), (8, None), (8, 1), (8, 2)):
        head += b"".join(f(c[value] if value is not None else "", width) for c in channels)
    head += b"".join(f(-32768, 8) for _ in channels) + b"".join(f(32767, 8) for _ in channels) + b"".join(f("", 80) for _ in channels)
    head += b"".join(f(rate, 8) for _ in channels) + b"".join(f("", 32) for _ in channels)
    body = b"".join(struct.pack(f"<{rate}h", *c[3][i * rate:(i + 1) * rate]) for i in range(n_records) for c in channels)
    path.write_bytes(head + body)


def test_edf_headers_and_record_ranges(spark, tmp_path):
    a = [((i * 37) % 60000) - 30000 for i in range(70)]
    b = [i for i in range(70)]
    write_edf(tmp_path / "one.edf", b"01.02.2403.04.05", [("EEG L", -2, 2, a), ("ECG", 0, 1, b)], 7, 10)
    write_edf(tmp_path / "two.EDF", b"xx.02.24xx.04.05", [("EEG R", -1, 1, a)], 7, 10)
    heads = edf.read_headers(spark, str(tmp_path))
    rows = {(r["path"].rsplit("/", 1)[-1], r["label"]): r for r in heads.collect()}
    one = rows[("one.edf", "EEG L")]
    assert (one["start_s"], one["sfreq"], one["n_ch"], one["n_records"]) == (1706756645.0, 10.0, 2, 7)
    assert rows[("two.EDF", "EEG R")]["start_s"] is None
    sig = edf.read_signals(heads.filter("label = 'EEG L'"), records_per_block=3).orderBy("block_id").collect()
    assert [len(r["samples"]) for r in sig] == [30, 30, 10] and [r["t0"] for r in sig] == [1706756645.0 + 3 * i for i in range(3)]
    x = np.concatenate([r["samples"] for r in sig])
    assert np.allclose(x, (np.array(a) + 32768) * (4 / 65535) - 2, atol=1e-5)
    part = edf.read_signals(heads.filter("label = 'ECG'"), 3, t_min=1706756645.0 + 3, t_max=1706756645.0 + 6).collect()
    assert [r["block_id"] for r in part] == [1]
    assert np.allclose(part[0]["samples"], (np.array(b[30:60]) + 32768) / 65535, atol=1e-6)


def test_injected_scorer(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "i int, z array<double>")
    got = {r["i"]: r["p"] for r in ml.score_windows(df, ml.linear_scorer([1.0, -2.0]), 2).collect()}
    assert got[3] == pytest.approx(1 / (1 + math.exp(-1.0)))


def test_registered_boosted_trees_are_the_operators(monkeypatch):
    """Both queries fit the full model: 300 rounds of depth 6."""
    import inspect
    from unittest.mock import MagicMock

    from chronoline.operators import ml
    from chronoline.plans import load_catalog, signal_queries

    fit, full = inspect.signature(ml.boosted_trees), []

    def seen(*args, **kwargs):
        bound = fit.bind(*args, **kwargs)
        bound.apply_defaults()
        full.append((bound.arguments["rounds"], bound.arguments["depth"]))
        return MagicMock()

    monkeypatch.setattr(ml, "boosted_trees", seen)
    monkeypatch.setattr(signal_queries, "_split_features", lambda s: (MagicMock(), MagicMock()))
    for name in ("F", "settle", "_told", "_judged"):
        monkeypatch.setattr(signal_queries, name, MagicMock())
    for name in ("boosted_trees_windows", "boosted_trees_facts"):
        load_catalog().QUERIES[name](MagicMock(), "")
    assert full == [(300, 6)] * 2
