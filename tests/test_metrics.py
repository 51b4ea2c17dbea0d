"""Metrics, pooling, splits and statistics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoline.operators import metrics as mt, pooling, ranking, runs, splits, stats
from chronoline.operators.blocks import Blocks

PRED = "run_id int, clip int, y int, pred int"


def f1_macro(y, p):
    out = []
    for c in sorted(set(y) | set(p)):
        tp = sum(a == b == c for a, b in zip(y, p))
        out.append(2 * tp / (y.count(c) + p.count(c)))
    return sum(out) / len(out)


def test_report_against_numpy(spark):
    r = random.Random(0)
    y = [r.choice([0, 0, 1, 2, 4]) for _ in range(300)]
    p = [a if r.random() < 0.6 else r.randint(0, 4) for a in y]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(y, p))], PRED)
    got = mt.classification_report(df).collect()[0]
    cm = np.zeros((5, 5))
    for a, b in zip(y, p):
        cm[a, b] += 1
    n, c = cm.sum(), np.trace(cm)
    t, q = cm.sum(1), cm.sum(0)
    mcc = (c * n - t @ q) / math.sqrt((n * n - q @ q) * (n * n - t @ t))
    present = t > 0
    assert got["accuracy"] == pytest.approx(c / n) and got["mcc"] == pytest.approx(mcc)
    assert got["balanced_accuracy"] == pytest.approx((np.diag(cm)[present] / t[present]).mean())
    assert got["macro_f1"] == pytest.approx(f1_macro(y, p))


def test_class_set_rules(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 3)], PRED)
    present = mt.classification_report(df).collect()[0]["macro_f1"]
    declared = mt.classification_report(df, classes="declared", n_classes=5).collect()[0]["macro_f1"]
    assert present == pytest.approx((2 / 3) / 2) and declared == pytest.approx((2 / 3) / 5)


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 1, 1)], PRED)
    r = mt.classification_report(df).collect()[0]
    assert r["mcc"] == 0.0 and r["balanced_accuracy"] == 1.0
    assert ranking.auroc(df.withColumn("score", F.lit(0.3))).collect()[0]["auroc"] is None


@pytest.mark.parametrize("blocks", [Blocks(10.0), Blocks(1 / 16), Blocks(1.0, hot_rows=5)])
def test_auroc_and_average_precision_with_ties(spark, blocks):
    r = random.Random(3)
    rows = [(1, r.randint(0, 1), r.randint(0, 20) / 20) for _ in range(200)]
    df = spark.createDataFrame(rows, "run_id int, y int, score double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert ranking.auroc(df, blocks=blocks).collect()[0]["auroc"] == pytest.approx(want)
    ap, tp = 0.0, 0
    for s in sorted({s for *_, s in rows}, reverse=True):
        here = [y for _, y, x in rows if x >= s]
        new = sum(here) - tp
        tp = sum(here)
        ap += new / len(pos) * tp / len(here)
    assert ranking.average_precision(df, blocks=blocks).collect()[0]["average_precision"] == pytest.approx(ap)


def pooled(spark, rows, **kw):
    df = spark.createDataFrame(rows, "run_id int, clip_id int, w_idx int, probs array<double>")
    return {(r["clip_id"], r["rule"]): r["probs"] for r in pooling.pool_windows(df, 2, **kw).collect()}


def test_pooling_rules(spark):
    rows = [(1, 1, 0, [0.0, 1.0]), (1, 1, 1, [0.5, 0.5]), (1, 2, 0, [0.2, 0.8])]
    got = pooled(spark, rows)
    assert all(sum(v) == pytest.approx(1.0) for v in got.values())
    assert got[(1, "mean")] == pytest.approx([0.25, 0.75])
    assert got[(1, "topk")] == pytest.approx([0.0, 1.0])
    lo, hi = math.sqrt(1e-9 * 0.5), math.sqrt(0.5)
    assert got[(1, "logmean")] == pytest.approx([lo / (lo + hi), hi / (lo + hi)])
    assert got[(2, "attn")] == pytest.approx([0.2, 0.8])


@pytest.mark.parametrize("n,k", [(2, 1), (6, 2), (10, 2)])
def test_top_share_rounds_half_to_even(spark, n, k):
    rows = [(1, 1, i, [i / 100, 1 - i / 100]) for i in range(n)]
    df = spark.createDataFrame(rows, "run_id int, clip_id int, w_idx int, probs array<double>")
    top = [r["w_idx"] for r in pooling.top_windows(df).filter("in_top").collect()]
    assert sorted(top) == list(range(k))


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 2, 7, 30, 101) for k in range(0, n + 1, max(1, n // 7))] + [(0, 0), (480, 1000)]
    df = spark.createDataFrame(cases, "k bigint, n bigint").withColumn("p", stats.binomial_two_sided(F.col("k"), F.col("n")))
    for r in df.collect():
        k, n = r["k"], r["n"]
        low = min(k, n - k)
        want = 1.0 if n == 0 or 2 * k == n else min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n)
        assert r["p"] == pytest.approx(want, rel=1e-9), (k, n)


def test_mcnemar_without_discordant_pairs(spark):
    df = spark.createDataFrame([(r, c, 1, 1) for r in (1, 2) for c in range(5)], PRED)
    assert stats.mcnemar(df, 1, 2).collect()[0]["p"] == 1.0


def test_resampling_agrees_with_draws_of_clips(spark):
    """The cells' multinomial draws against numpy resamples of the clips themselves."""
    import numpy as np

    r = random.Random(5)
    rows = []
    for c in range(400):
        y = r.randint(0, 1)
        rows += [(1, c, y, y if r.random() < 0.9 else 1 - y), (2, c, y, y if r.random() < 0.8 else 1 - y)]
    df = spark.createDataFrame(rows, PRED)
    got = stats.bootstrap_diff(df, 1, 2, n=800).collect()[0]
    ok = np.array([[x[3] for x in rows if x[0] == k] for k in (1, 2)]), np.array([x[2] for x in rows if x[0] == 1])
    rng, diffs = np.random.default_rng(1), []
    for _ in range(800):
        at = rng.integers(0, 400, 400)
        y = ok[1][at]
        f1 = [np.mean([2 * ((p == c) & (y == c)).sum() / ((p == c).sum() + (y == c).sum()) for c in (0, 1)]) for p in ok[0][:, at]]
        diffs.append(f1[0] - f1[1])
    assert got["mean_diff"] == pytest.approx(np.mean(diffs), abs=0.005)
    assert got["lo"] == pytest.approx(np.quantile(diffs, 0.025), abs=0.015) and got["hi"] == pytest.approx(np.quantile(diffs, 0.975), abs=0.015)


def test_resampled_counts_are_multinomial(spark):
    """Totals hold, means and variances are the multinomial's, also for cells of millions of clips."""
    import numpy as np

    cells = spark.createDataFrame([(0, 7_000_000), (1, 2_999_990), (2, 10)], "y int, n long")
    rows = stats.resample(cells, ("y",), 200, 7).groupBy("rep").pivot("y", [0, 1, 2]).agg(F.sum("n")).fillna(0).collect()
    x = np.array([[r["0"], r["1"], r["2"]] for r in rows], float)
    assert len(x) == 200 and (x.sum(axis=1) == 10_000_000).all()
    assert abs(x[:, 0].mean() - 7e6) < 4 * np.sqrt(2.1e6 / 200) and 0.75 < x[:, 0].var() / 2.1e6 < 1.3
    assert 9 < x[:, 2].mean() < 11 and 6 < x[:, 2].var() < 14
    small = spark.createDataFrame([(0, 1), (1, 1)], "y int, n long")
    assert {r["n"] for r in stats.resample(small, ("y",), 50, 1).groupBy("rep").agg(F.sum("n").alias("n")).collect()} == {2}
    assert stats.resample(small.filter("n > 5"), ("y",), 5, 1).count() == 0


@pytest.mark.parametrize("bucket", [50, 1 << 15])
def test_pairs_of_runs_equal_loops(spark, bucket):
    r = random.Random(9)
    rows = [(run, f"c{c}", r.randint(0, 2) if c % 7 == 0 else c % 3, r.randint(0, 2)) for run in range(6) for c in range(500) if (c + run) % 5]
    df = spark.createDataFrame([*rows, (9, "other", 1, 1)], "run_id int, clip string, y int, pred int").repartition(3)
    got = {(x["run_a"], x["run_b"]): (x["n"], x["a_only"], x["b_only"], x["label_conflicts"]) for x in stats.pairwise_mcnemar(df, bucket=bucket).collect()}
    by = {run: {c: (y, p) for k, c, y, p in rows if k == run} for run in range(6)}
    want = {}
    for a in range(6):
        for b in range(a + 1, 6):
            both = [(by[a][c], by[b][c]) for c in by[a] if c in by[b]]
            right = [(x[0] == x[1], y[0] == y[1]) for x, y in both]
            want[a, b] = (len(both), sum(p and not q for p, q in right), sum(q and not p for p, q in right), sum(x[0] != y[0] for x, y in both))
    assert got == want
    flags, labels = stats.correctness_bitmaps(df, bucket=bucket)
    assert flags.count() <= 7 * (500 // 64 + 2 + 3000 // bucket * 2) and stats.pairwise_mcnemar(df.filter("run_id = 1")).count() == 0


def clips_frame(spark, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, r.randint(0, 4), r.randint(0, 24), r.randint(0, 6)) for i in range(600)], "clip_id int, y int, session int, subject int")


def test_session_split_covers_both_sides_and_ignores_partitioning(spark):
    clips = clips_frame(spark)
    one = sorted(map(tuple, splits.session_split(clips, max_tries=40).collect()))
    assert len(one) == 25 and sum(v for _, v, _ in one) == 5
    val = {s for s, v, _ in one if v}
    rows = clips.collect()
    for side in (True, False):
        assert {r["y"] for r in rows if (r["session"] in val) == side} == {0, 1, 2, 3, 4}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = sorted(map(tuple, splits.session_split(clips.repartition(5), max_tries=40).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert again == one


def test_folds_are_a_partition(spark):
    folds = {r["subject"]: r["fold"] for r in splits.subject_folds(clips_frame(spark), 3).collect()}
    assert set(folds) == set(range(7)) and sorted(list(folds.values()).count(f) for f in range(3)) == [2, 2, 3]


def test_weights_average_one_and_floor_empty_classes(spark):
    w = {r["y"]: r["weight"] for r in splits.class_weights(spark.createDataFrame([(0,)] * 9 + [(1,)] * 3, "y int"), 3).collect()}
    assert sum(w.values()) / 3 == pytest.approx(1.0) and w[1] / w[0] == pytest.approx(3.0) and w[2] == pytest.approx(9 * w[0])


def test_run_tables(spark):
    m = spark.createDataFrame([("a", "t", s, v) for s, v in enumerate([0.9, 0.91, 0.92, 0.2, float("nan")])] + [("b", "t", 0, 0.5)], "arch string, task string, seed int, value double")
    s = {r["arch"]: r for r in runs.seed_summary(m).collect()}
    assert s["a"]["n"] == 4 and s["b"]["sd"] == 0.0
    kept = runs.drop_collapsed(m.filter(~F.isnan("value"))).filter("arch = 'a'").collect()
    assert sorted(r["seed"] for r in kept) == [0, 1, 2]
    gate = runs.reproduction_gate(runs.compare_runs(m.filter("seed < 2"), m.filter("seed < 2"), ("arch", "task", "seed"))).collect()[0]
    assert gate["passed"] and gate["worst"] == 0.0


@pytest.mark.parametrize("few", [2, 4096])
def test_exact_quantiles(spark, few):
    r = random.Random(8)
    rows = [(k, r.choice([r.random() * 9, 3.0, None])) for k in (1, 1, 2) for _ in range(60)] + [(3, 7.0)]
    got = {x["k"]: x for x in ranking.exact_quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", (0.1, 0.5, 0.9), few).collect()}
    for k in (1, 2, 3):
        mine = [v for g, v in rows if g == k and v is not None]
        assert got[k]["n"] == len(mine)
        assert [got[k][f"q_{i}"] for i in range(3)] == pytest.approx(list(np.percentile(mine, [10, 50, 90])))


def test_keys_keep_the_order_of_doubles(spark):
    import struct

    r = random.Random(4)
    xs = [0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 0.9999999999999999, 2.0, 4.0, 1.9999999999999998]
    xs += [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(3000)] + [2.0**k for k in range(-1074, 1024)] + [-(3.0**k) for k in range(-600, 600)]
    xs = [x for x in xs if x == x]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ranking.order_key(F.col("x")).alias("k")).collect()
    for row in rows:  # the bit pattern, mirrored below zero
        bits = struct.unpack("<q", struct.pack("<d", abs(row["x"])))[0]
        assert row["k"] == (-bits if row["x"] < 0 else bits), row
    assert spark.range(1).select(ranking.order_key(F.lit(float("nan"))) > ranking.order_key(F.lit(float("inf")))).first()[0]


@pytest.mark.parametrize("few", [3, 4096])
def test_quantiles_by_radix_selection(spark, few):
    import numpy as np

    r = random.Random(6)
    rows = [("a", r.random()) for _ in range(900)] + [("b", 0.25)] * 700 + [("b", r.gauss(0, 1e-3)) for _ in range(300)] + [("c", 7.0), ("d", -1.0), ("d", 2.0), ("e", None)]
    rows += [("f", r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    qs = (0.5, 0.1, 0.975, 0.0, 1.0)
    got = {x["g"]: x for x in ranking.exact_quantiles(df, ["g"], "v", qs, few=few).collect()}
    assert set(got) == set("abcdf")
    for g in got:
        own = np.array([v for k, v in rows if k == g and v is not None])
        assert got[g]["n"] == len(own)
        for j, q in enumerate(qs):
            assert got[g][f"q_{j}"] == pytest.approx(np.quantile(own, q), rel=1e-12), (g, q)
    whole = ranking.exact_quantiles(df.filter("g in ('a', 'b')"), [], "v", (0.5,), few=few).first()
    assert whole["n"] == 1900 and whole["q_0"] == pytest.approx(np.median([v for k, v in rows if k in "ab"]))
    assert ranking.exact_quantiles(df.filter("false"), ["g"], "v", (0.5,)).count() == 0
