"""A seeded integer mix that gives the same order on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = 2147483647  # values lie in [0, SPAN)


def mix(ident: Column, seed: Column | int) -> Column:
    """Hash an integer key with a seed; equal inputs give equal outputs everywhere."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    h = F.pmod(
        ident.cast("bigint") * F.lit(1103515245).cast("bigint") + seed.cast("bigint") * F.lit(12345) + F.lit(1013904223),
        F.lit(2147483648).cast("bigint"),
    )
    for c in (48271, 69621):
        high = F.shiftright(h, 16)
        h = F.pmod((h % F.lit(65536)) * high * F.lit(c).cast("bigint") + h, F.lit(SPAN).cast("bigint"))
    return h


def uniform(ident: Column, seed: Column | int) -> Column:
    """A reproducible uniform in [0, 1)."""
    return mix(ident, seed) / F.lit(float(SPAN))


def mix_sql(ident: str, seed: str | int) -> str:
    """The same mix as SQL text."""
    h = f"((CAST({ident} AS BIGINT) * 1103515245 + CAST({seed} AS BIGINT) * 12345 + 1013904223) % 2147483648)"
    for c in (48271, 69621):
        h = f"(((({h}) % 65536) * (({h}) // 65536) * {c} + ({h})) % {SPAN})"
    return h
