"""Sampled signals: windows, decimation, channel choice and quality audits.

A signal is stored as blocks of a fixed sample count. Operators that need samples
from the next or previous block let each block send the few it must lend (the
halo) to its neighbours, so no task ever holds a whole recording.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from chronoline.functions.numbers import half_even, let, mean, median_of, pop_sd, ratio, zip_fact
from chronoline.functions.paths import channel_kind, channel_rank
from chronoline.operators.ranking import exact_quantiles
from chronoline.session import settle

def pick_channel(channels: DataFrame, keys: Sequence[str] = ("session",), name: str = "name", ordinal: str = "ordinal", skip_fir: bool = False) -> DataFrame:
    """First EEG channel, else first ECG, else the first one."""
    if skip_fir:
        channels = channels.filter(~F.upper(name).contains("FIR"))
    best = F.min_by(F.struct(name, ordinal), F.struct(channel_rank(F.col(name)).alias("r"), F.col(ordinal).alias("o")))
    out = channels.groupBy(*keys).agg(best.alias("_b"))
    return out.select(*keys, f"_b.{name}", f"_b.{ordinal}", channel_kind(F.col(f"_b.{name}")).alias("kind"))


def decimation_factor(sfreq: Column, target_hz: float = 125.0) -> Column:
    """Whole factor from a rate to about the target rate, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), half_even(sfreq / F.lit(target_hz)))


def _joined(pieces: Column, block_len: int) -> Column:
    """Concatenate the own block and borrowed ones until the first gap."""
    none = F.expr("cast(array() as array<float>)")

    def step(acc: Column, p: Column) -> Column:
        follows = F.size(acc) == p["part"] * F.lit(block_len)
        return F.when(follows, F.concat(acc, p["xs"])).otherwise(acc)

    return F.aggregate(F.array_sort(pieces), none, step)


def sliding_windows(
    signal: DataFrame, win: int, stride: int, block_len: int, keys: Sequence[str] = ("session",), drop_gaps: bool = True,
) -> DataFrame:
    """Overlapping windows of ``win`` samples every ``stride``; partial ones dropped.

    ``signal`` has keys, block_id and samples; block b starts at sample b * block_len.
    Output: keys, w_idx, start (sample), samples.
    """
    reach = -(-(win - 1) // block_len)
    own = F.struct(F.col("block_id").cast("bigint").alias("owner"), F.lit(0).alias("part"), F.col("samples").alias("xs"))
    lent = [
        F.struct(
            (F.col("block_id") - j).cast("bigint").alias("owner"), F.lit(j).alias("part"),
            F.slice("samples", 1, min(block_len, win - 1 - (j - 1) * block_len)).alias("xs"),
        )
        for j in range(1, reach + 1)
    ]
    sent = signal.select(*keys, F.explode(F.array(own, *lent)).alias("s"))
    whole = sent.groupBy(*keys, F.col("s.owner").alias("_own")).agg(
        F.collect_list(F.struct(F.col("s.part").alias("part"), F.col("s.xs").alias("xs"))).alias("_pieces")
    ).select(*keys, "_own", _joined(F.col("_pieces"), block_len).alias("_x"))
    base = F.col("_own") * F.lit(block_len)
    first = F.ceil(base / F.lit(stride)).cast("bigint")
    last = F.floor(F.least(base + F.lit(block_len) - 1, base + F.size("_x") - F.lit(win)) / F.lit(stride)).cast("bigint")
    out = whole.filter(F.size("_x") > 0).withColumn(
        "w_idx", F.explode(F.filter(F.sequence(first, F.greatest(first, last)), lambda i: i <= last))
    )
    out = out.select(
        *keys, "w_idx", (F.col("w_idx") * stride).alias("start"),
        F.slice("_x", (F.col("w_idx") * stride - base + 1).cast("int"), win).alias("samples"),
    )
    if drop_gaps:
        out = out.filter((F.size("samples") == win) & ~F.exists("samples", lambda x: x.isNull() | F.isnan(x)))
    return out


def low_pass(factor: int, half_width: int = 10) -> np.ndarray:
    """Kaiser-windowed (beta 5) sinc with cut-off at the new Nyquist rate, unit gain."""
    h = half_width * factor
    n = np.arange(-h, h + 1)
    taps = np.sinc(n / factor) * np.kaiser(2 * h + 1, 5.0)
    return taps / taps.sum()


def decimate(signal: DataFrame, factor: int, block_len: int, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Low-pass and keep every ``factor``-th sample of the whole recording.

    Each block borrows half a filter length from both neighbours; beyond a gap or an
    edge the signal counts as zero. Output blocks hold the kept samples of the same
    stretch: keys, block_id, first (index of the first kept sample), samples.
    """
    if factor == 1:
        return signal.select(*keys, "block_id", (F.col("block_id") * block_len).alias("first"), "samples")
    taps = low_pass(factor)
    half = (len(taps) - 1) // 2
    if half > block_len:
        raise ValueError("blocks must be at least half a filter long")
    size = F.size("samples")
    sent = signal.select(*keys, F.explode(F.array(
        F.struct(F.col("block_id").cast("bigint").alias("owner"), F.lit(1).alias("part"), F.col("samples").alias("xs")),
        F.struct((F.col("block_id") - 1).cast("bigint").alias("owner"), F.lit(2).alias("part"), F.slice("samples", 1, half).alias("xs")),
        F.struct((F.col("block_id") + 1).cast("bigint").alias("owner"), F.lit(0).alias("part"),
                 F.slice("samples", F.greatest(size - half + 1, F.lit(1)), half).alias("xs")),
    )).alias("s"))
    part = lambda i: F.max(F.when(F.col("s.part") == i, F.col("s.xs")))
    packed = sent.groupBy(*keys, F.col("s.owner").alias("block_id")).agg(
        part(0).alias("_left"), part(1).alias("_own"), part(2).alias("_right")
    ).filter(F.col("_own").isNotNull())

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def filtered(left: pd.Series, own: pd.Series, right: pd.Series, block_id: pd.Series) -> pd.Series:
        out = []
        for a, x, b, blk in zip(left, own, right, block_id):
            x = np.asarray(x, dtype=np.float64)
            ext = np.zeros(len(x) + 2 * half)
            ext[half:half + len(x)] = x
            if a is not None and len(a):
                ext[half - len(a):half] = a
            if b is not None and len(b):
                ext[half + len(x):half + len(x) + len(b)] = b
            # only the kept samples are computed; the taps are symmetric
            y = np.lib.stride_tricks.sliding_window_view(ext, len(taps))[(-int(blk) * block_len) % factor::factor] @ taps
            out.append(y.astype(np.float32))
        return pd.Series(out)

    return packed.select(
        *keys, "block_id", F.ceil(F.col("block_id") * block_len / F.lit(float(factor))).cast("bigint").alias("first"),
        filtered("_left", "_own", "_right", "block_id").alias("samples"),
    )


def normalised(windows: DataFrame, eps: float = 0.0, samples: str = "samples", out: str = "z") -> DataFrame:
    """Per-window z-score with population sd; an sd of at most eps counts as one."""
    x = F.col(samples)
    # every sample meets its window's facts in a zipped array: they are computed once, and
    # the expression has no captured lambda variable, which a Python UDF's input may not have
    centred = zip_fact(x, mean(x), lambda v, m: v.cast("double") - m)
    sd = F.sqrt(mean(F.transform(centred, lambda d: d * d)))
    scaled = zip_fact(centred, sd, lambda d, s: d / F.when(s > F.lit(eps), s).otherwise(F.lit(1.0)))
    return windows.withColumn(out, scaled)


def clean_channel(xs: Column) -> Column:
    """Non-finite samples replaced, and a non-degenerate physical range.

    NaN and minus infinity become the lowest finite sample, plus infinity the highest;
    without any finite sample all become zero in (-1, 1).
    """
    inf = float("inf")
    finite = F.filter(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))
    lo, hi = F.array_min(finite).cast("double"), F.array_max(finite).cast("double")
    # lo and hi are null exactly when no sample is finite
    fixed = lambda r: F.transform(xs, lambda x: F.when(r["lo"].isNull(), F.lit(0.0)).when(x == F.lit(inf), r["hi"])
                                  .when(x.isNull() | F.isnan(x) | (x == F.lit(-inf)), r["lo"]).otherwise(x.cast("double")))
    flat = lambda r: r["hi"] <= r["lo"]
    return let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda r: F.struct(
        fixed(r).alias("samples"),
        F.when(r["lo"].isNull(), F.lit(-1.0)).when(flat(r), r["lo"] - 1e-6).otherwise(r["lo"]).alias("lo"),
        F.when(r["lo"].isNull(), F.lit(1.0)).when(flat(r), r["lo"] + 1e-6).otherwise(r["hi"]).alias("hi"),
    ))


def whole_records(xs: Column, sfreq: Column, record_s: float = 1.0) -> Column:
    """Samples cut to whole data records; null when not even one fits."""
    per = sfreq * F.lit(record_s)
    n = (F.floor(F.size(xs) / per) * per).cast("int")
    return F.when(n > 0, F.slice(xs, F.lit(1), F.greatest(n, F.lit(1))))


def signal_quality(
    signal: DataFrame, keys: Sequence[str] = ("clip_id",), min_unique: int = 100, samples: str = "samples", exact: bool = True,
) -> DataFrame:
    """Distinct values, sd, length and kind of each signal: flat, degenerate or normal.

    Sums come from the arrays in place; only each block's distinct values are
    shuffled. ``exact=False`` sketches the distinct count instead and shuffles none.
    """
    x = F.col(samples)
    total = lambda f: F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v.cast("double"))))
    sums = signal.groupBy(*keys).agg(
        F.sum(F.size(x)).alias("n"), total(lambda v: v).alias("_s"), total(lambda v: v * v).alias("_ss"),
        F.min(F.array_min(x)).alias("_lo"), F.max(F.array_max(x)).alias("_hi"),
    )
    values = signal.select(*keys, F.explode(F.array_distinct(samples)).alias("_x"))
    count = F.count_distinct("_x") if exact else F.approx_count_distinct("_x")
    q = sums.join(values.groupBy(*keys).agg(count.alias("n_uniq")), list(keys))
    var = F.greatest(F.lit(0.0), F.col("_ss") / F.col("n") - F.pow(F.col("_s") / F.col("n"), F.lit(2.0)))
    kind = F.when(F.col("_lo") == F.col("_hi"), "flat").when(F.col("n_uniq") < min_unique, "degenerate").otherwise("normal")
    return q.select(*keys, "n_uniq", "n", F.sqrt(var).alias("sd"), kind.alias("kind"))


def quality_overview(quality: DataFrame) -> DataFrame:
    """Share of each kind and spread of the distinct counts."""
    is_ = lambda k: F.avg((F.col("kind") == k).cast("double"))
    shares = quality.agg(F.count(F.lit(1)).alias("n"), is_("flat").alias("flat"), is_("degenerate").alias("degenerate"), is_("normal").alias("normal"))
    spread = exact_quantiles(quality, [], "n_uniq", (0.5, 0.1, 0.9)).select(
        F.struct(F.col("q_0").alias("median_uniq"), F.col("q_1").alias("p10_uniq"), F.col("q_2").alias("p90_uniq")).alias("_q"))
    return shares.withColumn("_q", spread.scalar()).select(*shares.columns, "_q.*")


def _bad() -> Column:
    return F.col("kind") != "normal"


def quality_confound(quality: DataFrame, event: str = "is_event", limit: float = 0.05) -> DataFrame:
    """Does signal quality track the label: bad rates of both classes and their difference."""
    rate = lambda v: F.avg(F.when(F.col(event) == v, _bad().cast("double")))
    r = quality.agg(rate(True).alias("event_bad"), rate(False).alias("other_bad"))
    return r.withColumn("difference", F.abs(F.col("event_bad") - F.col("other_bad"))).withColumn("confounded", F.col("difference") > limit)


def quality_by_subject(quality: DataFrame, by: str = "subject") -> DataFrame:
    """Bad share and median distinct count per subject."""
    return quality.groupBy(by).agg(
        F.count(F.lit(1)).alias("clips"), F.avg(_bad().cast("double")).alias("bad_share"), F.percentile("n_uniq", F.lit(0.5)).alias("median_uniq")
    )


def bad_sessions(quality: DataFrame, by: str = "session") -> DataFrame:
    """Sessions, those entirely bad, and their share."""
    per = quality.groupBy(by).agg(F.bool_and(_bad()).alias("all_bad"))
    return per.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("all_bad").alias("entirely_bad"), F.avg(F.col("all_bad").cast("double")).alias("share"))


def quality_gate(quality: DataFrame, limit: float = 0.2) -> DataFrame:
    """Share of unusable clips and whether training may start (Q02)."""
    return quality.agg(F.avg(_bad().cast("double")).alias("bad_share")).withColumn("passed", F.col("bad_share") <= limit)


def repair_worklist(clips: DataFrame) -> DataFrame:
    """Reason code per clip, first that applies.

    Needs has_note, kind (null without a signal), note_start, note_end, source_path,
    source_start and source_len.
    """
    t0 = F.greatest(F.lit(0.0), F.col("note_start") - F.col("source_start"))
    t1 = F.least(F.col("source_len"), F.col("note_end") - F.col("source_start"))
    status = (
        F.when(~F.col("has_note"), "no_info").when(F.col("kind") == "normal", "already_ok")
        .when(F.col("note_start").isNull() | F.col("note_end").isNull(), "bad_info").when(F.col("source_path").isNull(), "no_source")
        .when(F.col("source_start").isNull(), "no_meas_date").when(t1 - t0 < 1.0, "bad_window").otherwise("to_repair")
    )
    return clips.withColumn("status", status)


def repair_tally(worklist: DataFrame) -> DataFrame:
    return worklist.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def window_usability(windows: DataFrame, samples: str = "samples") -> DataFrame:
    """Usable windows: finite, not flat, and not pinned at a rail."""
    x = F.col(samples)
    mad = let(median_of(x), lambda m: median_of(F.transform(x, lambda v: F.abs(v.cast("double") - m))))
    pinned = lambda edge: let(edge.cast("double"), lambda e: F.size(F.filter(x, lambda v: F.abs(v.cast("double") - e) <= 1e-12)) / F.size(x))
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    railed = F.greatest(pinned(F.array_max(x)), pinned(F.array_min(x)))
    w = windows.withColumn("mad", mad)
    ok = finite & (F.array_max(x) > F.array_min(x)) & (F.col("mad") > 0) & (railed < 0.05)
    return w.withColumn("usable", F.coalesce(ok, F.lit(False)))


def beat_stats(windows: DataFrame, sfreq: float, mad_factor: float = 4.0, samples: str = "samples", max_bpm: float = 600.0) -> DataFrame:
    """Peak rate and interval variation of each window.

    Own convention: peaks are local maxima of the signal's distance from its median at or
    above ``mad_factor`` times its median absolute deviation, kept left to right at least
    60 / max_bpm apart. Intervals outside 0.08-0.5 s are ignored. Null with fewer
    than five peaks or four intervals. ``windows`` needs the column ``mad``.
    """
    gap = int(sfreq * 60.0 / max_bpm)
    facts = F.struct(
        let(median_of(samples), lambda m: F.transform(samples, lambda x: F.abs(x.cast("double") - m))).alias("a"), (F.lit(mad_factor) * F.col("mad")).alias("floor")
    )

    def peaks(f: Column) -> Column:
        at = lambda i: F.get(f["a"], i)
        return F.filter(
            F.sequence(F.lit(1), F.size(f["a"]) - 2), lambda i: (at(i) >= f["floor"]) & (at(i) > at(i - 1)) & (at(i) >= at(i + 1))
        )

    spaced = lambda pk: F.aggregate(
        pk, F.expr("cast(array() as array<int>)"),
        lambda acc, i: F.when((F.size(acc) == 0) | (i - F.element_at(F.concat(F.array(F.lit(-gap)), acc), -1) >= gap), F.concat(acc, F.array(i))).otherwise(acc),
    )
    rest = lambda pk, i: F.slice(pk, i, F.greatest(F.size(pk) - 1, F.lit(0)))
    rr = lambda pk: F.filter(F.zip_with(rest(pk, 2), rest(pk, 1), lambda b, a: (b - a) / F.lit(float(sfreq))), lambda r: (r > 0.08) & (r < 0.5))

    def beat(pk: Column) -> Column:
        return let(rr(pk), lambda r: F.when((F.size(pk) >= 5) & (F.size(r) >= 4), F.struct(
            (F.lit(1.0) / median_of(r)).alias("rate"), (pop_sd(r) / mean(r)).alias("cv"))))

    w = windows.withColumn("_beat", let(facts, lambda f: let(spaced(peaks(f)), beat)))
    return w.withColumn("rate", F.col("_beat.rate")).withColumn("cv", F.col("_beat.cv")).drop("_beat")


def rhythm_census(beats: DataFrame, by: str = "subject", min_ok: int = 4) -> DataFrame:
    """Signal type per subject from its windows' rhythm.

    ``beats`` has usable, rate and cv per window.
    """
    ok = F.col("usable")
    beats = settle(beats.select(by, "usable", "rate", "cv"))
    counts = beats.groupBy(by).agg(F.count_if(ok).alias("n_ok"), F.count_if(ok & F.col("rate").isNotNull()).alias("_n"))
    good = beats.filter(ok)
    med = lambda c: exact_quantiles(good, [by], c, (0.5,)).select(by, F.col("q_0").alias(c))
    g = counts.join(med("rate"), by, "left").join(med("cv"), by, "left").withColumn("share", ratio(F.col("_n"), F.col("n_ok")))
    rhythmic = F.col("rate").between(3.5, 10.0) & (F.col("cv") < 0.35) & (F.col("share") > 0.5)
    verdict = F.when(F.col("n_ok") < min_ok, "unusable").when(rhythmic, "ECG-like").otherwise("EEG-like")
    return g.withColumn("verdict", verdict).drop("_n")


def census_agreement(census: DataFrame, labels: DataFrame, by: str = "subject", label: str = "kind") -> DataFrame:
    """Agreement of the census with the channel labels."""
    j = census.join(labels.select(by, label), by)
    used = F.col("verdict") != "unusable"
    same = F.substring("verdict", 1, 3) == F.col(label)
    return j.agg(F.count_if(used & same).alias("agree"), F.count_if(used & ~same).alias("disagree"), F.count_if(~used).alias("unusable"))


def motion_energy(frames: DataFrame, keys: Sequence[str] = ("clip_id",), order: str = "w_idx", pixels: str = "samples") -> DataFrame:
    """Mean absolute difference of consecutive frames per clip.

    Consecutive frames meet by an equi-join on the frame number.
    """
    a = frames.select(*keys, F.col(order).alias("_i"), F.col(pixels).alias("_a"))
    b = frames.select(*keys, (F.col(order) - 1).alias("_i"), F.col(pixels).alias("_b"))
    d = a.join(b, [*keys, "_i"]).withColumn("_d", mean(F.zip_with("_a", "_b", lambda x, y: F.abs(y.cast("double") - x.cast("double")))))
    return d.groupBy(*keys).agg(F.avg("_d").alias("motion"))


def quantisation_audit(signal: DataFrame, file: str = "file", channel: str = "channel", samples: str = "samples", levels: int = 65535) -> DataFrame:
    """Step size and distinct levels of a channel under the file's and its own range.

    Ranges come from the blocks' array bounds. Levels are numbered inside each block's array; a block
    sends its distinct ones only, and they are set as bits of the channel's bitmaps, combined before
    the shuffle: 8 KB for 65,536 levels, however many samples there are.
    """
    blocks = signal.select(file, channel, F.transform(samples, lambda v: v.cast("double")).alias("_x"))
    own = settle(blocks.groupBy(file, channel).agg(F.min(F.array_min("_x")).alias("_lo"), F.max(F.array_max("_x")).alias("_hi")))
    shared = own.groupBy(file).agg(F.min("_lo").alias("_flo"), F.max("_hi").alias("_fhi"))
    ranges = own.join(shared, file).withColumn("shared_step", (F.col("_fhi") - F.col("_flo")) / levels).withColumn("own_step", (F.col("_hi") - F.col("_lo")) / levels)
    level = lambda lo, st: F.transform("_x", lambda v: F.floor((v - F.col(lo)) / F.when(F.col(st) > 0, F.col(st)).otherwise(F.lit(1.0))))
    own_kind = lambda kind, lo, st: F.transform(F.array_distinct(F.array_compact(level(lo, st))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))
    sent = blocks.join(ranges, [file, channel]).select(
        file, channel, F.explode(F.concat(own_kind("shared", "_flo", "shared_step"), own_kind("own", "_lo", "own_step"))).alias("_l"))
    maps = sent.groupBy(file, channel, "_l.kind", F.bitmap_bucket_number("_l.v").alias("_b")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("_l.v"))).alias("_n"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("_n"))), F.lit(0)).cast("bigint")
    counts = maps.groupBy(file, channel).agg(of("shared").alias("shared_levels"), of("own").alias("own_levels"))
    zero = F.lit(0).cast("bigint")
    return ranges.join(counts, [file, channel], "left").select(
        file, channel, "shared_step", "own_step", F.coalesce("shared_levels", zero).alias("shared_levels"), F.coalesce("own_levels", zero).alias("own_levels"))
