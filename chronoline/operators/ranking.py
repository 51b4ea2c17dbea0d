"""Rank metrics from cumulative counts: AUROC and average precision."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoline.functions.numbers import let
from chronoline.operators.blocks import Blocks, Run, running
from chronoline.session import settle

SCORES = Blocks(width=1.0 / 256.0)


def _counts(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """One row per distinct score, so the ordered pass sees no duplicates."""
    return df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg")
    )


def auroc(
    df: DataFrame, keys: Sequence[str] = ("run_id",), score: str = "score", label: str = "y",
    blocks: Blocks = SCORES,
) -> DataFrame:
    """Mann-Whitney AUROC, ties count one half; null when a class is missing."""
    c = _counts(df, keys, score, F.col(label) == 1)
    c = running(c, keys, "_s", [Run("_below", "sum", F.col("_neg"), "before")], blocks=blocks)
    return c.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)),
            (F.sum("_pos") * F.sum("_neg")).cast("double"),
        ).alias("auroc")
    )


def average_precision(
    df: DataFrame, keys: Sequence[str] = ("run_id",), score: str = "score", label: str = "y",
    blocks: Blocks = SCORES,
) -> DataFrame:
    """Step-wise average precision over distinct scores, highest first."""
    c = _counts(df, keys, score, F.col(label) == 1)
    c = running(
        c, keys, "_s",
        [Run("_tp", "sum", F.col("_pos"), "from"), Run("_fp", "sum", F.col("_neg"), "from")], blocks=blocks,
    )
    return c.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))), F.sum("_pos").cast("double")
        ).alias("average_precision")
    )


def auroc_ovr(
    df: DataFrame, keys: Sequence[str] = ("run_id",), item: str = "clip_id", cls: str = "k", prob: str = "p",
    label: str = "y", present_only: bool = False, n_classes: int = 5, blocks: Blocks = SCORES,
) -> DataFrame:
    """Macro one-vs-rest AUROC over long-form class probabilities (A10).

    ``present_only`` keeps the classes that occur as labels and renormalises the
    probabilities over them; otherwise an absent class makes the result null.
    """
    keys = list(keys)
    if present_only:
        present = df.select(*keys, F.col(label).alias(cls)).distinct()
        df = df.join(present, [*keys, cls])
        total = df.groupBy(*keys, item).agg(F.sum(prob).alias("_total"))
        df = df.join(total, [*keys, item]).withColumn(prob, F.col(prob) / F.col("_total")).drop("_total")
    one = df.withColumn("_y", (F.col(label) == F.col(cls)).cast("int"))
    per = auroc(one, [*keys, cls], prob, "_y", blocks)
    macro = F.avg("auroc")
    if not present_only:
        macro = F.when(F.count("auroc") == n_classes, macro)
    return per.groupBy(*keys).agg(macro.alias("auroc"))


def attribute_leakage(
    df: DataFrame, attributes: Sequence[str], label: str = "y", limit: float = 0.99,
    blocks: Blocks | None = None,
) -> DataFrame:
    """AUROC of each metadata column alone; near 0 or 1 means it gives the label away."""
    long = df.select(
        F.col(label).alias("y"),
        F.explode(F.array(*[
            F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("score")) for a in attributes
        ])).alias("_a"),
    ).select("y", "_a.*").filter(F.col("score").isNotNull())
    a = auroc(long, ["attribute"], blocks=blocks or Blocks(width=4096.0))
    return a.withColumn("leaks", (F.col("auroc") >= F.lit(limit)) | (F.col("auroc") <= F.lit(1.0 - limit)))


def order_key(x: Column) -> Column:
    """A long that orders doubles as they are ordered, one for each value; both zeros share one, NaN is last.

    It is the number's own bit pattern, put together from its exponent and its fraction: scaling by a power
    of two is exact. Negative numbers are mirrored.
    """
    size = F.abs(x)
    near = F.floor(F.log2(size)).cast("int")  # may be one off beside a power of two
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    put_right = lambda e: F.when(size < power(e), e - 1).when(size >= power(e) * 2.0, e + 1).otherwise(e)
    exponent = F.greatest(F.lit(-1022), F.least(F.lit(1023), put_right(F.greatest(F.lit(-1022), F.least(F.lit(1023), near)))))
    fraction = lambda e: size / power(e) - F.when(size < power(e), 0.0).otherwise(1.0)  # no leading one below the least exponent
    whole = lambda e: F.when(size < power(e), F.lit(0)).otherwise(e + 1023).cast("bigint") * F.lit(1 << 52) + (fraction(e) * float(1 << 52)).cast("bigint")
    top = F.lit(2047 << 52)
    bits = F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), top).otherwise(let(exponent, whole))
    return F.when(F.isnan(x), top + 1).when(x < 0, -bits).otherwise(bits)


#: Bits of the key that a pass reads, and how many rows a range may hold to be sorted at once.
DIGIT, FEW = 16, 4096


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], few: int = FEW) -> DataFrame:
    """Interpolated exact quantiles per key as columns q_0, q_1, ... and the count n.

    The built-in exact percentile keeps every distinct value of a group in one task. Here wanted
    ranks are found by radix selection: a pass counts rows by the next 16 bits of an order-keeping key, which
    is combined before the shuffle, and only the ranges that hold a wanted rank are read again. A
    range ends where it holds one value or ``few`` rows; 64 bits are four passes at most.
    """
    keys = list(keys)
    by = keys or ["_all"]
    x = F.col(value).cast("double")
    rows = df.filter(F.col(value).isNotNull()).select(*(keys or [F.lit(0).alias("_all")]), x.alias("_x"), order_key(x).alias("_k"))
    rows = settle(rows)
    n = settle(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    at = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*[f(at(q)).cast("bigint") for q in qs for f in (F.floor, F.ceil)]))
    # an open rank, and the range it lies in: the leading bits of its key and its rank inside
    open_ = n.select(*by, F.explode(ranks).alias("_rank")).withColumn("_p", F.lit(0).cast("bigint")).withColumn("_r", F.col("_rank"))
    found, left, shift = [], rows, 64
    while True:
        prefix = lambda bits: F.shiftright("_k", bits) if bits < 64 else F.lit(0).cast("bigint")
        parts = left.groupBy(*by, prefix(shift).alias("_p"), prefix(shift - DIGIT).alias("_d")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        spec = W.partitionBy(*by, "_p").orderBy("_d").rowsBetween(W.unboundedPreceding, 0)  # 2 ** DIGIT rows at most
        placed = parts.withColumn("_upto", F.sum("_c").over(spec))
        inside = (F.col("_upto") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_upto"))
        hit = settle(placed.join(open_, [*by, "_p"]).filter(inside).select(
            *by, "_rank", F.col("_d").alias("_p"), (F.col("_r") - F.col("_upto") + F.col("_c")).alias("_r"), "_c", "_lo", "_hi"))
        found.append(hit.filter(F.col("_lo") == F.col("_hi")).select(*by, "_rank", F.col("_lo").alias("_x")))
        more, shift = hit.filter(F.col("_lo") != F.col("_hi")), shift - DIGIT
        ranges = more.select(*by, "_p", "_c").distinct()
        kept = left.withColumn("_p", prefix(shift)).join(ranges, [*by, "_p"])
        small = kept.filter(F.col("_c") <= few).withColumn("_r", F.row_number().over(W.partitionBy(*by, "_p").orderBy("_x")) - 1)
        found.append(small.select(*by, "_p", "_r", "_x").join(more.filter(F.col("_c") <= few), [*by, "_p", "_r"]).select(*by, "_rank", "_x"))
        open_ = more.filter(F.col("_c") > few).select(*by, "_rank", "_p", "_r")
        if shift == 0 or open_.isEmpty():
            break
        left = settle(kept.filter(F.col("_c") > few).select(*by, "_x", "_k"))
    values = reduce(DataFrame.unionByName, found).join(n, by)
    pick = lambda i: F.max(F.when(F.col("_rank") == i, F.col("_x")))
    cols = []
    for j, q in enumerate(qs):
        low, high = pick(F.floor(at(q))), pick(F.ceil(at(q)))
        cols.append((low + (high - low) * F.max(at(q) - F.floor(at(q)))).alias(f"q_{j}"))
    return values.groupBy(*by).agg(F.max("n").alias("n"), *cols).select(*keys, "n", *[f"q_{j}" for j in range(len(qs))])
