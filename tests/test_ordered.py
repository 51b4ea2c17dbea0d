"""Blocked scans, interval algebra and as-of joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from chronoline.operators import intervals as iv, timeline
from chronoline.operators.blocks import Blocks, Run, neighbours, row_numbers, running
from chronoline.operators.background import sample_background

# wide, narrow, and narrow with every block cut again
CUTS = [Blocks(1e6), Blocks(7.0), Blocks(50.0, hot_rows=3)]


def make_rows(seed, n=120, keys=3):
    r = random.Random(seed)
    # one key holds most rows
    return [(r.choice([0] * 6 + list(range(keys))), float(r.randint(0, 400)) / 4, i, r.choice([None, r.randint(-5, 5)])) for i in range(n)]


@pytest.mark.parametrize("blocks", CUTS)
def test_running_values_match_a_plain_scan(spark, blocks):
    rows = make_rows(1)
    df = spark.createDataFrame(rows, "k int, t double, i int, v int")
    runs = [
        Run("s_upto", "sum", F.col("v"), "upto"), Run("s_before", "sum", F.col("v"), "before"), Run("m_from", "max", F.col("v"), "from"),
        Run("n_after", "nearest", F.col("v"), "after"), Run("n_upto", "nearest", F.col("v"), "upto"), Run("lo", "min", F.col("v"), "upto"),
    ]
    got = {r["i"]: r for r in running(df, ["k"], "t", runs, ("i",), blocks).collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for p, row in enumerate(ordered):
            past, future = [x[3] for x in ordered[: p + 1]], [x[3] for x in ordered[p:]]
            known = lambda xs: [x for x in xs if x is not None]
            g = got[row[2]]
            assert g["s_upto"] == sum(known(past)) and g["s_before"] == sum(known(past[:-1]))
            assert g["m_from"] == max(known(future), default=None)
            assert g["n_after"] == next(iter(known(future[1:])), None)
            assert g["n_upto"] == next(iter(reversed(known(past))), None)
            assert g["lo"] == min(known(past), default=None)


@pytest.mark.parametrize("blocks", CUTS)
def test_row_numbers_without_keys(spark, blocks):
    df = spark.createDataFrame(make_rows(2), "k int, t double, i int, v int")
    got = [(r["t"], r["i"]) for r in row_numbers(df, [], "t", "n", ("i",), blocks).orderBy("n").collect()]
    assert got == sorted(got) and len(got) == 120


def merged(intervals, gap=0.0):
    out = []
    for s, e in sorted(intervals):
        if out and s - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def random_intervals(seed, n=80):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = r.randint(0, 1200) / 4
        out.append((r.choice([0, 0, 0, 1, 2]), s, s + r.choice([0.25, 1.0, 5.0, 60.0 if r.random() < 0.2 else 2.0])))
    return out


@pytest.mark.parametrize("blocks", CUTS)
@pytest.mark.parametrize("gap", [0.0, 1.5])
def test_merge_intervals(spark, blocks, gap):
    rows = random_intervals(3)
    df = spark.createDataFrame(rows, "session int, t_start double, t_end double")
    got = sorted(map(tuple, iv.merge_intervals(df, gap=gap, blocks=blocks).collect()))
    want = sorted((k, *m) for k in range(3) for m in merged([r[1:] for r in rows if r[0] == k], gap))
    assert got == want
    again = spark.createDataFrame(got, "session int, t_start double, t_end double")
    assert sorted(map(tuple, iv.merge_intervals(again, gap=gap, blocks=blocks).collect())) == got


@pytest.mark.parametrize("blocks", CUTS)
def test_islands_mark_every_row(spark, blocks):
    rows = [(*r, i) for i, r in enumerate(random_intervals(4))]
    df = spark.createDataFrame(rows, "session int, t_start double, t_end double, i int")
    for r in iv.assign_islands(df, "t_start", "t_end", blocks=blocks).collect():
        runs = merged([x[1:3] for x in rows if x[0] == r["session"]])
        assert r["island_start"] == next(s for s, e in runs if s <= r["t_start"] <= e)


@pytest.mark.parametrize("blocks", CUTS)
def test_neighbours_on_equal_times(spark, blocks):
    r = random.Random(5)
    left = [(r.choice([0, 0, 1]), float(r.randint(0, 60)), i) for i in range(60)]
    right = [(r.choice([0, 0, 1]), float(r.randint(10, 50)), j) for j in range(30)]
    lf = spark.createDataFrame(left, "k int, t double, i int")
    rt = spark.createDataFrame(right, "k int, u double, j int")
    for first in (True, False):
        rows = neighbours(lf, rt, ["k"], "t", "u", ["u", "j"], first, ("j",), blocks).collect()
        assert len(rows) == len(left)
        for x in rows:
            same = sorted((u, j) for k, u, j in right if k == x["k"])
            before = [p for p in same if (p[0] < x["t"] if first else p[0] <= x["t"])]
            after = [p for p in same if p not in before]
            assert (tuple(x["prev"]) if x["prev"] else None) == (before[-1] if before else None)
            assert (tuple(x["next"]) if x["next"] else None) == (after[0] if after else None)


def recordings_and_points(seed):
    r = random.Random(seed)
    rec, pts = [], []
    for i in range(60):
        s = float(r.randint(0, 300))
        rec.append((r.choice([0, 0, 1]), f"f{i:02d}", s, s + r.choice([3.0, 10.0, 80.0])))
    for i in range(150):
        pts.append((r.choice([0, 0, 1, 2]), i, float(r.randint(-5, 400))))
    return rec, pts


@pytest.mark.parametrize("blocks", CUTS)
def test_cover_and_nearest(spark, blocks):
    rec, pts = recordings_and_points(6)
    rdf = spark.createDataFrame(rec, "session int, path string, t_start double, t_end double")
    pdf = spark.createDataFrame(pts, "session int, i int, t_start double")
    cover = {r["i"]: r["path"] for r in iv.cover_join(pdf, rdf, blocks=blocks).collect()}
    near = {r["i"]: (r["nearest_path"], r["gap_s"]) for r in iv.nearest_recording(pdf, rdf, blocks=blocks).collect()}
    for k, i, t in pts:
        mine = sorted((x for x in rec if x[0] == k), key=lambda x: (x[2], x[1]))
        assert cover[i] == next((x[1] for x in mine if x[2] <= t < x[3]), None)
        best = min(mine, key=lambda x: abs(x[2] - t), default=None)
        assert near[i] == ((best[1], t - best[3]) if best else (None, None))


def test_cover_is_half_open(spark):
    rec = spark.createDataFrame([(1, "a", 0.0, 10.0), (1, "b", 10.0, 20.0)], "session int, path string, t_start double, t_end double")
    pts = spark.createDataFrame([(1, 10.0), (1, 20.0)], "session int, t_start double")
    got = {r["t_start"]: r["path"] for r in iv.cover_join(pts, rec).collect()}
    assert got == {10.0: "b", 20.0: None}


@pytest.mark.parametrize("blocks", CUTS)
def test_free_time_and_blocked_time_tile_each_recording(spark, blocks):
    rec, _ = recordings_and_points(7)
    ev = random_intervals(8)
    rdf = spark.createDataFrame(rec, "session int, path string, t_start double, t_end double")
    b = iv.merge_intervals(spark.createDataFrame(ev, "session int, t_start double, t_end double"), blocks=blocks)
    free = iv.free_intervals(rdf, b, blocks=blocks).collect()
    for k, path, s, e in rec:
        runs = merged([x[1:] for x in ev if x[0] == k])
        want, at = [], s
        for bs, be in runs:
            if be <= s or bs >= e:
                continue
            if at < bs:
                want.append((at, bs))
            at = max(at, be)
        if at < e:
            want.append((at, e))
        assert sorted((f["t_start"], f["t_end"]) for f in free if f["path"] == path) == want


def test_background_never_touches_blocked_time_and_skips_exact_fits(spark):
    rec = spark.createDataFrame([(1, "a", 0.0, 1000.0), (1, "b", 2000.0, 9000.0)], "session int, path string, t_start double, t_end double")
    ev = spark.createDataFrame([(1, 1, 500.0, 530.0), (1, 2, 3000.0, 3400.0), (1, 3, 10.0, 8000.0)], "session int, idx int, t_start double, t_end double")
    two = ev.filter("idx < 3")
    b = iv.merge_intervals(two, pad_before=40.0, pad_after=40.0)
    got = {r["idx"]: r for r in sample_background(two, rec, b).collect()}
    assert got[1]["path"] == "a" and got[2]["path"] == "b"
    blocked = [(460.0, 570.0), (2960.0, 3440.0)]
    for r in got.values():
        assert all(r["clip_end"] <= s or r["clip_start"] >= e for s, e in blocked)
    # a free piece exactly as long as the clip offers no start
    exact = spark.createDataFrame([(1, 9, 100.0, 110.0)], "session int, idx int, t_start double, t_end double")
    room = spark.createDataFrame([(1, "c", 0.0, 90.0)], "session int, path string, t_start double, t_end double")
    none = sample_background(exact, room, iv.merge_intervals(exact, pad_before=40.0, pad_after=40.0), pre=25.0, post=25.0).collect()[0]
    assert none["path"] is None and none["clip_start"] is None


def test_moving_average_crosses_chunks(spark):
    rows = [(1, "v", float(i), float(i % 5)) for i in range(40)] + [(2, "v", float(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "session int, modality string, t double, p double")
    got = {(r["session"], r["t"]): r["smooth"] for r in timeline.moving_average(df, 5, blocks=Blocks(6.0), chunk=7).collect()}
    for i in range(40):
        want = sum(float(j % 5) for j in range(max(0, i - 2), min(40, i + 3))) / 5.0
        assert got[(1, float(i))] == pytest.approx(want)
    assert got[(2, 0.0)] == 1.0  # not longer than the window: left alone
