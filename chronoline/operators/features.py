"""Window features: band powers and time-domain statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from chronoline.functions.numbers import diffs, let, mean, pop_sd

# fixed values: band edges in Hz, low edge included
BANDS = ((0.5, 4.0), (4.0, 8.0), (8.0, 13.0), (13.0, 30.0), (30.0, 60.0))
BAND_NAMES = ("delta", "theta", "alpha", "beta", "gamma")
STAT_NAMES = ("mean", "sd", "rms", "line_length", "activity", "zero_crossings", "min", "max", "range")
FEATURES = tuple(f"band_{b}" for b in BAND_NAMES) + STAT_NAMES


def band_powers(fs: float = 125.0, bands: Sequence[tuple[float, float]] = BANDS):
    """Arrow UDF: relative spectral power of each band."""
    edges = [tuple(b) for b in bands]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def powers(xs: pd.Series) -> pd.Series:
        out = [None] * len(xs)
        sizes = xs.map(len)
        for n in sizes.unique():
            at = np.flatnonzero((sizes == n).to_numpy())
            x = np.stack([np.asarray(xs.iloc[i], dtype=np.float64) for i in at])
            power = np.abs(np.fft.rfft(x, axis=1)) ** 2
            freq = np.fft.rfftfreq(int(n), 1.0 / fs)
            total = power.sum(axis=1) + 1e-8
            shares = np.stack([power[:, (freq >= lo) & (freq < hi)].sum(axis=1) / total for lo, hi in edges], axis=1)
            for row, i in enumerate(at):
                out[i] = shares[row].tolist()
        return pd.Series(out)

    return powers


def time_features(windows: DataFrame, samples: str = "samples") -> DataFrame:
    """Nine statistics of each window, in built-in expressions."""
    x = F.col(samples)
    rest = lambda i: F.slice(x, i, F.greatest(F.size(x) - 1, F.lit(0)))
    crossings = F.filter(F.zip_with(rest(2), rest(1), lambda b, a: b.cast("double") * a.cast("double")), lambda p: p < 0)
    steps = let(diffs(x), lambda d: F.struct(
        F.aggregate(d, F.lit(0.0), lambda a, v: a + F.abs(v)).alias("length"),
        let(pop_sd(d), lambda sd: F.size(F.filter(d, lambda v: F.abs(v) > sd))).alias("busy"),
    ))
    lo, hi = F.array_min(x).cast("double"), F.array_max(x).cast("double")
    return (
        windows.withColumn("_st", steps)
        .withColumn("mean", mean(x)).withColumn("sd", pop_sd(x))
        .withColumn("rms", F.sqrt(mean(F.transform(x, lambda v: v.cast("double") * v.cast("double")))))
        .withColumn("line_length", F.col("_st.length")).withColumn("activity", F.col("_st.busy"))
        .withColumn("zero_crossings", F.size(crossings))
        .withColumn("min", lo).withColumn("max", hi).withColumn("range", hi - lo)
        .drop("_st")
    )


def window_features(windows: DataFrame, fs: float = 125.0, samples: str = "samples") -> DataFrame:
    """All fourteen features in a stable order."""
    w = time_features(windows.withColumn("_b", band_powers(fs)(samples)), samples)
    for i, b in enumerate(BAND_NAMES):
        w = w.withColumn(f"band_{b}", F.get("_b", F.lit(i)))
    keep = [c for c in windows.columns if c != samples]
    return w.select(*keep, *FEATURES)
