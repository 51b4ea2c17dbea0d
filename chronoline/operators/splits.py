"""Leakage-safe splits by seeded order, class counts and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chronoline.functions.hashing import SPAN, mix
from chronoline.functions.numbers import half_even
from chronoline.operators.blocks import Blocks, row_numbers
from chronoline.session import settle

# seeded hashes are uniform on [0, SPAN): equal slots hold equal shares
_SLOTS = Blocks(width=SPAN / 64.0)


def seeded_order(df: DataFrame, ident: str, seed, keys: Sequence[str] = (), out: str = "place") -> DataFrame:
    """Reproducible random position (from 1) of each row within keys."""
    h = df.withColumn("_h", mix(F.col(ident), seed))
    return row_numbers(h, list(keys), "_h", out, (ident,), _SLOTS).drop("_h")


def session_split(
    clips: DataFrame, seed: int = 49, val_frac: float = 0.2, n_classes: int = 5, need_all: bool = True,
    max_tries: int = 500, session: str = "session",
) -> DataFrame:
    """Session-disjoint split: the first seed that puts every class on both sides.

    All seeds are tried in one query on the (session, class) counts; clips join last.
    Output: session, is_val, split_seed. An error when no seed qualifies.
    """
    present = settle(clips.groupBy(session, "y").agg(F.count(F.lit(1)).alias("n")))
    sessions = present.select(session).distinct()
    tries = sessions.withColumn("split_seed", F.explode(F.sequence(F.lit(seed), F.lit(seed + max_tries - 1))))
    placed = seeded_order(tries, session, F.col("split_seed"), ["split_seed"])
    total = sessions.agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "split_seed", F.explode(F.sequence(F.lit(seed), F.lit(seed + max_tries - 1)))
    )
    n_val = F.greatest(F.lit(1).cast("bigint"), half_even(F.col("_n") * F.lit(val_frac)))
    sides = placed.join(total, "split_seed").select(session, "split_seed", (F.col("place") <= n_val).alias("is_val"))
    if not need_all:
        return sides.filter(F.col("split_seed") == seed)
    sides = settle(sides)
    seen = sides.join(present, session).groupBy("split_seed").agg(
        *[F.max(((F.col("y") == c) & (F.col("is_val") == v)).cast("int")).alias(f"_{c}_{int(v)}")
          for c in range(n_classes) for v in (True, False)]
    )
    good = None
    for c in range(n_classes):
        for v in (0, 1):
            test = F.col(f"_{c}_{v}") == 1
            good = test if good is None else good & test
    first = seen.filter(good).agg(F.min("split_seed").alias("split_seed"))
    if first.first()["split_seed"] is None:
        raise ValueError(f"no seed from {seed} to {seed + max_tries - 1} puts every class on both sides")
    return sides.join(F.broadcast(first), "split_seed").select(session, "is_val", "split_seed")


def subject_folds(clips: DataFrame, n_folds: int = 5, seed: int = 49, subject: str = "subject") -> DataFrame:
    """Subjects dealt round robin to folds in seeded order."""
    placed = seeded_order(clips.select(subject).distinct(), subject, seed)
    return placed.select(subject, F.pmod(F.col("place") - 1, F.lit(n_folds)).alias("fold"))


def subject_fraction(clips: DataFrame, frac: float, seed: int = 1049, subject: str = "subject") -> DataFrame:
    """A seeded share of the subjects, at least one."""
    subjects = clips.select(subject).distinct()
    placed = seeded_order(subjects, subject, seed)
    total = subjects.agg(F.count(F.lit(1)).alias("_n"))
    keep = F.greatest(F.lit(1).cast("bigint"), half_even(total.scalar() * F.lit(frac)))
    return placed.filter(F.col("place") <= keep).select(subject)


def seeded_sample(df: DataFrame, ident: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same ones on every run (O06): a top-k of the seeded hash."""
    return df.orderBy(mix(F.col(ident), seed), F.col(ident)).limit(n)


def systematic_sample(df: DataFrame, order: str, every: int, ties: Sequence[str] = (), blocks: Blocks = Blocks(width=10_000.0)) -> DataFrame:
    """Every k-th row of a numeric order, first one included."""
    return row_numbers(df, [], order, "_n", ties, blocks).filter((F.col("_n") - 1) % every == 0).drop("_n")


def class_counts(clips: DataFrame, n_classes: int, keys: Sequence[str] = ("is_val",)) -> DataFrame:
    """Clips per class on a dense class grid."""
    n = clips.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
    grid = n.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    return grid.join(n, [*keys, "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_weights(clips: DataFrame, n_classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Inverse class frequencies scaled to mean one; empty classes count as one clip."""
    sums = clips.groupBy(*keys).agg(
        *[F.count_if(F.col("y") == c).alias(f"_{c}") for c in range(n_classes)]
    )
    inv = F.array(*[F.lit(1.0) / F.greatest(F.col(f"_{c}"), F.lit(1)) for c in range(n_classes)])
    level = F.aggregate(inv, F.lit(0.0), lambda a, x: a + x) / F.lit(float(n_classes))
    return sums.select(*keys, F.posexplode(F.transform(inv, lambda x: x / level)).alias("y", "weight"))


def split_overlap(clips: DataFrame, split: DataFrame, group: str) -> DataFrame:
    """Groups found on both sides of a split; must be empty."""
    sides = clips.join(split, group).select(group, "is_val")
    return sides.filter("is_val").select(group).intersect(sides.filter(~F.col("is_val")).select(group))
