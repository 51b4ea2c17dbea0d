"""Ordered analytics in bounded pieces.

A window partitioned by session puts a whole session into one task. One session
may hold a third of all rows, so no operator here does that. Instead the ordered
axis is cut into blocks, and each ordered computation is done in three steps:

1. inside a block (keys + block), with an ordinary window;
2. over one summary row per block (a tiny table), with a window by keys;
3. the two are combined after an equi-join on keys + block.

Step 1 shuffles rows by (keys, block), so a hot key spreads over the cluster.
A block that itself holds more than ``hot_rows`` rows is cut again into equal
parts. The list of such blocks has at most rows / hot_rows entries, which is why
it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoline.session import settle

BLK = "_blk"


@dataclass(frozen=True)
class Blocks:
    """How the ordered axis is cut: block width, and when to cut a block again."""

    width: float = 86_400.0
    hot_rows: int | None = 4_000_000


DAILY = Blocks()


# block numbers are integers: a floating-point key would be normalised in every
# exchange and hide that two of them agree. The low bits number the parts of a block.
_PARTS = 1 << 20
# hot blocks that may be broadcast
MAX_LISTED = 100_000


def _base(t: Column, blocks: Blocks) -> Column:
    return F.floor(t / F.lit(blocks.width)).cast("bigint") * F.lit(_PARTS)


def hot_blocks(frames: Sequence[tuple[DataFrame, str]], keys: Sequence[str], blocks: Blocks):
    """Blocks holding more than ``hot_rows`` rows over all frames, with a part count; None if there are none.

    Counted once, here: without hot blocks, the usual case, later plans read their input for
    its rows alone. A list of at most ``MAX_LISTED`` blocks is broadcast, a longer one joined.
    """
    if blocks.hot_rows is None:
        return None
    counts = [
        df.groupBy(*keys, _base(F.col(t), blocks).alias(BLK)).agg(F.count(F.lit(1)).alias("_n"))
        for df, t in frames
    ]
    merged = reduce(DataFrame.unionByName, counts)
    if len(counts) > 1:
        merged = merged.groupBy(*keys, BLK).agg(F.sum("_n").alias("_n"))
    hot = merged.filter(F.col("_n") > blocks.hot_rows).select(
        *keys, BLK, F.least(F.ceil(F.col("_n") / F.lit(blocks.hot_rows)), F.lit(_PARTS)).cast("double").alias("_parts")
    )
    rows = hot.limit(MAX_LISTED + 1).collect()
    if not rows:
        return None
    return F.broadcast(hot.sparkSession.createDataFrame(rows, hot.schema)) if len(rows) <= MAX_LISTED else settle(hot)


def assign(df: DataFrame, keys: Sequence[str], t: str, blocks: Blocks, hot: DataFrame | None) -> DataFrame:
    """Add the block number; parts of a hot block get numbers in between, in order."""
    df = df.withColumn(BLK, _base(F.col(t), blocks))
    if hot is None:
        return df
    x = F.col(t) / F.lit(blocks.width)
    nth = F.least(F.floor((x - F.floor(x)) * F.col("_parts")), F.col("_parts") - 1)
    part = F.floor(nth * F.lit(float(_PARTS)) / F.col("_parts")).cast("bigint")
    return (
        df.join(hot, [*keys, BLK], "left")
        .withColumn(BLK, F.col(BLK) + F.coalesce(part, F.lit(0)))
        .drop("_parts")
    )


def blocked(df: DataFrame, keys: Sequence[str], t: str, blocks: Blocks = DAILY) -> DataFrame:
    return assign(df, keys, t, blocks, hot_blocks([(df, t)], keys, blocks))


@dataclass(frozen=True)
class Run:
    """One running value: kind is sum, max, min or nearest; side says which rows.

    side: before / upto look back (without / with the row), after / from look ahead.
    ``nearest`` is the closest non-null value on that side.
    """

    out: str
    kind: str
    value: Column
    side: str = "upto"


_FRAME = {
    "before": (W.unboundedPreceding, -1),
    "upto": (W.unboundedPreceding, 0),
    "after": (1, W.unboundedFollowing),
    "from": (0, W.unboundedFollowing),
}
_PLAIN = {"sum": F.sum, "max": F.max, "min": F.min}


def _back(side: str) -> bool:
    return side in ("before", "upto")


def _over(run: Run, value: Column, spec) -> Column:
    if run.kind == "nearest":
        pick = F.last if _back(run.side) else F.first
        return pick(value, ignorenulls=True).over(spec)
    return _PLAIN[run.kind](value).over(spec)


def _summary(run: Run, value: Column, order: Column) -> Column:
    if run.kind == "nearest":
        pick = F.max_by if _back(run.side) else F.min_by
        return pick(value, F.when(value.isNotNull(), order))
    return _PLAIN[run.kind](value)


def _merge(run: Run, local: Column, carry: Column) -> Column:
    if run.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if run.kind == "max":
        return F.greatest(local, carry)
    if run.kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def carry_over(summaries: DataFrame, keys: Sequence[str], runs: Sequence[Run]) -> DataFrame:
    """Turn per-block summaries (columns ``_s_<out>``) into carries (``_c_<out>``)."""
    cols = []
    for r in runs:
        frame = (W.unboundedPreceding, -1) if _back(r.side) else (1, W.unboundedFollowing)
        spec = W.partitionBy(*keys).orderBy(BLK).rowsBetween(*frame)
        cols.append(_over(r, F.col(f"_s_{r.out}"), spec).alias(f"_c_{r.out}"))
    return summaries.select(*keys, BLK, *cols)


def running(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    runs: Sequence[Run],
    ties: Sequence[str] = (),
    blocks: Blocks = DAILY,
) -> DataFrame:
    """Add running values in (t, ties) order within keys, without a whole-key window."""
    rows = blocked(df, keys, t, blocks)
    for i, r in enumerate(runs):
        rows = rows.withColumn(f"_v{i}", r.value)
    order = F.struct(t, *ties)
    sums = rows.groupBy(*keys, BLK).agg(
        *[_summary(r, F.col(f"_v{i}"), order).alias(f"_s_{r.out}") for i, r in enumerate(runs)]
    )
    carries = carry_over(sums, keys, runs)
    local = rows.select(
        "*",
        *[
            _over(
                r, F.col(f"_v{i}"),
                W.partitionBy(*keys, BLK).orderBy(t, *ties).rowsBetween(*_FRAME[r.side]),
            ).alias(f"_l_{r.out}")
            for i, r in enumerate(runs)
        ],
    )
    joined = local.join(carries, [*keys, BLK], "left")
    return joined.select(
        *df.columns,
        *[_merge(r, F.col(f"_l_{r.out}"), F.col(f"_c_{r.out}")).alias(r.out) for r in runs],
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    out: str,
    ties: Sequence[str] = (),
    blocks: Blocks = DAILY,
) -> DataFrame:
    """``row_number()`` (from 1) in (t, ties) order within keys."""
    return running(df, keys, t, [Run(out, "sum", F.lit(1).cast("bigint"))], ties, blocks)


def neighbours(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    values: Sequence[str],
    left_first: bool,
    ties: Sequence[str] = (),
    blocks: Blocks = DAILY,
    keep: Sequence[str] = ("prev", "next"),
) -> DataFrame:
    """For every left row, the right rows just before and just after it.

    Adds the structs ``prev`` and ``next`` (fields ``values``, null where there is
    none). At equal times ``left_first=True`` makes the equal right row the next
    one (next is >=, prev is <); ``False`` makes it the previous one (next is >,
    prev is <=). ``ties`` order right rows that share a time.
    """
    payload = F.struct(*[F.col(v) for v in values])
    hot = hot_blocks([(left, left_t), (right, right_t)], keys, blocks)
    lft = assign(left, keys, left_t, blocks, hot)
    rgt = assign(right, keys, right_t, blocks, hot)
    tie_struct = F.struct(F.lit(0).alias("_z"), *[F.col(c) for c in ties])

    picks = {"prev": Run("prev", "nearest", payload, "upto"), "next": Run("next", "nearest", payload, "from")}
    runs = [picks[k] for k in keep]

    # blocks holding left rows only need a carry as well
    order = F.struct(F.col(right_t).alias("_t"), tie_struct.alias("_tie"))
    facts = rgt.select(*keys, BLK, payload.alias("_p"), order.alias("_o")).unionByName(
        lft.select(*keys, BLK), allowMissingColumns=True
    )
    sums = facts.groupBy(*keys, BLK).agg(*[_summary(r, F.col("_p"), F.col("_o")).alias(f"_s_{r.out}") for r in runs])
    carries = carry_over(sums, keys, runs)

    rows_l = lft.select(
        *keys, BLK, F.col(left_t).alias("_t"), F.lit(0 if left_first else 1).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_l"),
    )
    rows_r = rgt.select(
        *keys, BLK, F.col(right_t).alias("_t"), F.lit(1 if left_first else 0).alias("_side"),
        tie_struct.alias("_tie"), payload.alias("_p"),
    )
    both = rows_l.unionByName(rows_r, allowMissingColumns=True)
    spec = W.partitionBy(*keys, BLK).orderBy("_t", "_side", "_tie")
    local = both.select(
        "*",
        *[
            _over(r, F.col("_p"), spec.rowsBetween(*_FRAME[r.side])).alias(f"_l_{r.out}")
            for r in runs
        ],
    ).filter(F.col("_l").isNotNull())
    return local.join(carries, [*keys, BLK], "left").select(
        "_l.*",
        *[F.coalesce(F.col(f"_l_{r.out}"), F.col(f"_c_{r.out}")).alias(r.out) for r in runs],
    )
