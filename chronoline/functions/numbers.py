"""Small numeric expressions: rounding, clamping, vector reductions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(c: Column | str) -> Column:
    """Six decimals, never negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def half_even(x: Column) -> Column:
    """Round to an integer, ties to the even neighbour."""
    return F.bround(x, 0).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A column named in one projection and used inside a lambda in the next is inlined
    into the lambda and computed again for every element; a lambda argument is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def zip_fact(xs: Column, fact: Column, f) -> Column:
    """``f(element, fact)`` for every element, the fact computed once."""
    return F.zip_with(xs, F.array_repeat(fact, F.size(xs)), f)


def mean(xs: Column) -> Column:
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(xs).cast("double"))


def pop_sd(xs: Column) -> Column:
    """Population standard deviation of an array, two passes."""
    squares = lambda m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x.cast("double") - m) * (x.cast("double") - m))
    return let(mean(xs), lambda m: F.sqrt(F.try_divide(squares(m), F.size(xs).cast("double"))))


def median_of(xs: Column) -> Column:
    """Median of an array (mean of the two middle values)."""
    at = lambda s, i: F.get(s, i.cast("int")).cast("double")
    mid = lambda s: (at(s, F.floor((F.size(s) - 1) / 2)) + at(s, F.floor(F.size(s) / 2))) / 2.0
    return let(F.array_sort(xs), lambda s: F.when(F.size(s) > 0, mid(s)))


def argmax(p: Column) -> Column:
    """Index of the largest entry, lowest index on ties (P20)."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def diffs(xs: Column) -> Column:
    """Successive differences."""
    n = F.size(xs)
    return F.zip_with(
        F.slice(xs, 2, F.greatest(n - 1, F.lit(0))), F.slice(xs, 1, F.greatest(n - 1, F.lit(0))),
        lambda b, a: b.cast("double") - a.cast("double"),
    )


def collapse(y: Column, n_classes: int) -> Column:
    """Five grades to three or two classes."""
    if n_classes == 5:
        return y
    if n_classes == 3:
        return F.when(y == 0, 0).when(y <= 2, 1).otherwise(2)
    if n_classes == 2:
        return F.when(y == 0, 0).otherwise(1)
    raise ValueError("n_classes must be 2, 3 or 5")


def sample_indices(n_total: Column, n_sample: int, truncate: bool = False) -> Column:
    """Evenly spaced frame indices, rounded or cut; short inputs repeat their last index."""
    step = (n_total - 1).cast("double") / F.lit(float(max(n_sample - 1, 1)))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(n_sample - 1)), lambda i: F.floor(i * step) if truncate else half_even(i * step))
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(n_sample - 1)), lambda i: F.least(i, F.greatest(n_total - 1, F.lit(0))).cast("bigint")
    )
    return F.when(n_total >= n_sample, spaced).otherwise(padded)


def nearest_available(wanted: Column, available: Column) -> Column:
    """Closest available index, the lower one on ties."""
    return F.array_min(F.transform(available, lambda a: F.struct(F.abs(a - wanted).alias("d"), a.alias("i"))))["i"]


def even_floor(x: Column) -> Column:
    """Largest even integer not above x."""
    return F.floor(x / 2) * 2
