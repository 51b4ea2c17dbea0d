"""Paired tests, bootstrap intervals and seed statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoline.functions.hashing import uniform
from chronoline.functions.numbers import let
from chronoline.operators.metrics import paired_runs, per_class, summarise_classes
from chronoline.operators.ranking import exact_quantiles
from chronoline.session import settle


def log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series on x + 8, stepped back by the recurrence."""
    y = x + 8.0
    series = (
        (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi))
        + 1.0 / (12.0 * y) - 1.0 / (360.0 * y * y * y) + 1.0 / (1260.0 * y * y * y * y * y)
    )
    steps = x
    for i in range(1, 8):
        steps = steps * (x + float(i))
    return series - F.log(steps)


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p of k successes in n fair trials, 1 when n is 0.

    The lower tail is summed downwards from min(k, n - k); terms further than ten
    standard deviations from it no longer change a double, so the sum stays short.
    """
    low = F.least(k, n - k).cast("bigint")
    far = F.greatest(F.lit(0).cast("bigint"), low - F.ceil(F.sqrt(n.cast("double")) * 10.0) - 50)
    nd = n.cast("double")
    head = log_gamma(nd + 1.0) - nd * F.lit(math.log(2.0))
    term = lambda i: F.exp(head - log_gamma(i.cast("double") + 1.0) - log_gamma(nd - i.cast("double") + 1.0))
    tail = F.aggregate(F.sequence(far, low), F.lit(0.0), lambda a, i: a + term(i))
    return F.when((n == 0) | (k * 2 == n), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def mcnemar(pred: DataFrame, run_a: int, run_b: int, key: str = "clip") -> DataFrame:
    """Exact McNemar test of two runs on their shared clips."""
    j = paired_runs(pred, run_a, run_b, key)
    a, b = F.col("pred_a") == F.col("y"), F.col("pred_b") == F.col("y")
    n = j.agg(F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"))
    return n.withColumn("p", binomial_two_sided(F.col("a_only"), F.col("a_only") + F.col("b_only")))


#: Rows of predictions in one bucket of clips, about.
BUCKET = 1 << 15


def correctness_bitmaps(pred: DataFrame, key: str = "clip", run: str = "run_id", bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(flags, labels): 64 clips to a word, what each run has seen and has right, and its clips of each label.

    Clips are numbered inside buckets of their hash, of about ``bucket`` rows each. ``flags`` has _b, _w, r, seen
    and right; ``labels`` has _b, _w, y, r and bits.
    """
    flags = pred.groupBy(key, run).agg(F.max("y").alias("y"), F.max((F.col("pred") == F.col("y")).cast("int")).alias("_ok"))
    flags = settle(flags.select(F.col(key).alias("_k"), F.col(run).alias("r"), "y", "_ok"))
    buckets = max(1, -(-flags.count() // bucket))
    placed = flags.withColumn("_b", F.pmod(F.xxhash64("_k"), F.lit(buckets)))
    placed = placed.withColumn("_i", F.dense_rank().over(W.partitionBy("_b").orderBy("_k")) - 1)
    words = placed.withColumn("_w", F.shiftright("_i", 6)).withColumn("_bit", F.expr("shiftleft(1L, _i & 63)"))
    none = F.lit(0).cast("bigint")
    seen = words.groupBy("_b", "_w", "r").agg(
        F.bit_or("_bit").alias("seen"), F.coalesce(F.bit_or(F.when(F.col("_ok") == 1, F.col("_bit"))), none).alias("right")
    )
    return settle(seen), settle(words.filter(F.col("y").isNotNull()).groupBy("_b", "_w", "y", "r").agg(F.bit_or("_bit").alias("bits")))


def pairwise_mcnemar(pred: DataFrame, key: str = "clip", run: str = "run_id", bucket: int = BUCKET) -> DataFrame:
    """McNemar test of every unordered pair of runs, and whether their labels agree.

    Runs meet word by word of their bitmaps, and bits count the clips: rows are runs x words of 64
    clips. Pairs without a common clip are left out.
    """
    flags, labels = correctness_bitmaps(pred, key, run, bucket)
    sides = lambda d, columns: (d.withColumnsRenamed({c: f"{c}_{s}" for c in ("r", *columns)}) for s in "ab")
    a, b = sides(flags, ("seen", "right"))
    both = F.col("seen_a").bitwiseAND(F.col("seen_b"))
    only = lambda x, y: both.bitwiseAND(F.col(x)).bitwiseAND(F.bitwise_not(F.col(y)))
    bits = lambda c: F.sum(F.bit_count(c)).cast("bigint")
    n = a.join(b, ["_b", "_w"]).filter("r_a < r_b").groupBy(F.col("r_a").alias("run_a"), F.col("r_b").alias("run_b")).agg(
        bits(both).alias("n"), bits(only("right_a", "right_b")).alias("a_only"), bits(only("right_b", "right_a")).alias("b_only")
    ).filter("n > 0")
    x, y = sides(labels, ("bits",))
    same = x.join(y, ["_b", "_w", "y"]).filter("r_a < r_b").groupBy(F.col("r_a").alias("run_a"), F.col("r_b").alias("run_b")).agg(
        bits(F.col("bits_a").bitwiseAND(F.col("bits_b"))).alias("_same")
    )
    joined = n.join(same, ["run_a", "run_b"], "left")
    out = joined.withColumn("label_conflicts", F.col("n") - F.coalesce("_same", F.lit(0))).drop("_same")
    return out.withColumn("p", binomial_two_sided(F.col("a_only"), F.col("a_only") + F.col("b_only")))


def null_calibration(pred: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Share of same-model seed pairs that test significant, and the macro-F1 range."""
    pairs = pairwise_mcnemar(pred).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("p") < alpha).alias("significant"),
        F.avg((F.col("p") < alpha).cast("double")).alias("share"),
    )
    cells = pred.groupBy("run_id", "y", "pred").agg(F.count(F.lit(1)).alias("n"))
    f1 = summarise_classes(per_class(cells, ("run_id",)), ("run_id",)).agg(
        F.avg("macro_f1").alias("mean_f1"), F.stddev_samp("macro_f1").alias("sd_f1"),
        F.min("macro_f1").alias("min_f1"), F.max("macro_f1").alias("max_f1"),
    )
    return pairs.withColumn("_f", f1.select(F.struct("*")).scalar()).select(*pairs.columns, "_f.*")


def binomial_draw(n: Column, p: Column, u: Column) -> Column:
    """A binomial count of n trials (1 or more) at 0 < p < 1 by inverse sums: the first k whose sum of terms passes u.

    Terms are summed where they can change a double, ten standard deviations around the mean, so a
    draw takes steps with the root of n. The same u gives the same count on every engine.
    """
    nd = n.cast("double")
    spread = F.sqrt(nd * p * (1.0 - p)) * 10.0 + 20.0
    low = F.greatest(F.lit(0.0), F.floor(nd * p - spread)).cast("bigint")
    high = F.least(n, F.ceil(nd * p + spread).cast("bigint"))
    log_head = lambda k: (
        log_gamma(nd + 1.0) - log_gamma(k + 1.0) - log_gamma(nd - k + 1.0) + k * F.log(p) + (nd - k) * F.log(1.0 - p)
    )

    def step(a: Column, k: Column) -> Column:
        total = a["total"] + a["term"]
        return F.struct(
            total.alias("total"), (a["term"] * (n - k) / (k + 1) * p / (1.0 - p)).alias("term"), F.when(u >= total, k + 1).otherwise(a["x"]).alias("x")
        )

    start = lambda lo: F.struct(F.lit(0.0).alias("total"), F.exp(log_head(lo.cast("double"))).alias("term"), lo.alias("x"))
    return let(F.struct(low.alias("lo"), high.alias("hi")), lambda r: F.aggregate(F.sequence(r["lo"], r["hi"] - 1), start(r["lo"]), step)["x"])


def resample(cells: DataFrame, fields: Sequence[str], n_rep: int, seed: int) -> DataFrame:
    """Bootstrap counts per replicate: multinomial draws over the cells, as conditional binomials.

    The metrics depend on clips only through the cell counts (at most K^3), and resampling n clips with
    replacement makes those multinomial. Cell after cell takes its share of the draws that are
    left, by one seeded uniform for each replicate and cell; clips are never repeated.
    """
    packed = cells.agg(F.array_sort(F.collect_list(F.struct(*fields, "n"))).alias("cells"), F.sum("n").alias("total"))
    base = packed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))))
    # replicates are tiny before they multiply, so a given number of partitions, which none may merge
    base = base.filter("total > 0").repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rep")
    start = F.struct(F.col("total").alias("left"), F.col("total").alias("weight"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        c = F.get("cells", i)["n"]
        u = uniform(i.cast("bigint"), F.lit(seed) + F.col("rep") * 7919 + 1)
        drawn = F.when(c == a["weight"], a["left"]).when(a["left"] == 0, F.lit(0).cast("bigint")).otherwise(
            binomial_draw(a["left"], c.cast("double") / a["weight"], u)
        )
        return let(drawn, lambda x: F.struct((a["left"] - x).alias("left"), (a["weight"] - c).alias("weight"), F.concat(a["out"], F.array(x)).alias("out")))

    drawn = base.select("rep", "cells", F.aggregate(F.sequence(F.lit(0), F.size("cells") - 1), start, step)["out"].alias("_n"))
    return drawn.select("rep", F.explode(F.arrays_zip("cells", "_n")).alias("z")).select(
        "rep", *[F.col(f"z.cells.{f}").alias(f) for f in fields], F.col("z._n").alias("n")
    ).filter(F.col("n") > 0)


def bootstrap_diff(
    pred: DataFrame, run_a: int, run_b: int, metric: str = "macro_f1", n: int = 2000, seed: int = 0,
    level: float = 0.95, key: str = "clip",
) -> DataFrame:
    """Paired bootstrap of the metric difference a - b: mean and interval."""
    cells = paired_runs(pred, run_a, run_b, key).groupBy("y", "pred_a", "pred_b").agg(F.count(F.lit(1)).alias("n"))
    res = resample(cells, ("y", "pred_a", "pred_b"), n, seed)
    sides = res.select(
        "rep", "y", "n", F.explode(F.array(
            F.struct(F.lit(1).alias("side"), F.col("pred_a").alias("pred")),
            F.struct(F.lit(-1).alias("side"), F.col("pred_b").alias("pred")),
        )).alias("_s"),
    ).groupBy("rep", "_s.side", "y", "_s.pred").agg(F.sum("n").alias("n"))
    m = summarise_classes(per_class(sides, ("rep", "side")), ("rep", "side"))
    d = m.groupBy("rep").agg(F.sum(F.col(metric) * F.col("side")).alias("d"))
    lo = (1.0 - level) / 2.0
    return d.agg(
        F.avg("d").alias("mean_diff"), F.percentile("d", F.lit(lo)).alias("lo"), F.percentile("d", F.lit(1.0 - lo)).alias("hi")
    )


def bootstrap_interval(
    pred: DataFrame, run_id: int, metric: str = "macro_f1", n: int = 2000, seed: int = 0, level: float = 0.95,
) -> DataFrame:
    """Bootstrap mean and interval of one run's metric."""
    cells = pred.filter(F.col("run_id") == run_id).groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    res = resample(cells, ("y", "pred"), n, seed)
    m = summarise_classes(per_class(res, ("rep",)), ("rep",))
    lo = (1.0 - level) / 2.0
    return m.agg(
        F.lit(run_id).alias("run_id"), F.avg(metric).alias("mean"), F.percentile(metric, F.lit(lo)).alias("lo"),
        F.percentile(metric, F.lit(1.0 - lo)).alias("hi"),
    )


def intervals_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Do two runs' intervals overlap."""
    x = a.select(F.col("run_id").alias("run_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    y = b.select(F.struct(F.col("run_id").alias("run_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b")))
    apart = (F.col("lo_a") > F.col("hi_b")) | (F.col("lo_b") > F.col("hi_a"))
    return x.withColumn("_y", y.scalar()).select("run_a", "lo_a", "hi_a", "_y.*").withColumn("overlap", ~apart)


def medians_by_outcome(
    pred: DataFrame, covariate: DataFrame, run_a: int, run_b: int, value: str, key: str = "clip", min_n: int = 50,
) -> DataFrame:
    """Median of a covariate where each run is right or wrong; only with more than min_n values."""
    j = paired_runs(pred, run_a, run_b, key).join(covariate.select(key, value), key).filter(F.col(value).isNotNull())
    side = lambda name, p: F.when(F.col(p) == F.col("y"), f"{name}_right").otherwise(f"{name}_wrong")
    long = j.select(value, F.explode(F.array(F.lit("median_all"), side("a", "pred_a"), side("b", "pred_b"))).alias("_g"))
    med = exact_quantiles(long, ["_g"], value, (0.5,))
    of = lambda g: F.max(F.when(F.col("_g") == g, F.col("q_0"))).alias(g)
    return med.agg(
        F.max(F.when(F.col("_g") == "median_all", F.col("n"))).alias("n"),
        *[of(g) for g in ("median_all", "a_right", "a_wrong", "b_right", "b_wrong")],
    ).filter(F.col("n") > min_n)


def median_split_recall(
    pred: DataFrame, covariate: DataFrame, run_a: int, run_b: int, value: str, key: str = "clip", min_n: int = 12,
) -> DataFrame:
    """Per class: recall of both runs in the low and high half of a covariate."""
    j = paired_runs(pred, run_a, run_b, key).join(covariate.select(key, value), key).filter(F.col(value).isNotNull())
    med = exact_quantiles(j, ["y"], value, (0.5,)).select("y", F.col("q_0").alias("median"), "n")
    k = j.join(med.filter(F.col("n") >= min_n), "y")
    low = F.col(value) <= F.col("median")
    share = lambda hit, half: F.avg(F.when(half, hit.cast("double")))
    a, b = F.col("pred_a") == F.col("y"), F.col("pred_b") == F.col("y")
    return k.groupBy("y").agg(
        F.max("n").alias("n"), F.max("median").alias("median"), share(a, low).alias("a_low"), share(a, ~low).alias("a_high"),
        share(b, low).alias("b_low"), share(b, ~low).alias("b_high"),
    )
