"""Window posteriors to clip posteriors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronoline.functions.numbers import argmax, half_even, ratio
from chronoline.operators.blocks import Blocks, row_numbers
from chronoline.operators.metrics import classification_report

RULES = ("mean", "max", "topk", "logmean", "attn")
_CONF = Blocks(width=1.0 / 64.0)


def _normed(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(p)


def top_windows(scores: DataFrame, frac: float = 0.25, keys: Sequence[str] = ("run_id", "clip_id")) -> DataFrame:
    """Mark each clip's most confident share of windows, at least one.

    Adds conf, n, top_conf and the flag in_top. Ranks come from a blocked pass, so a
    clip with very many windows is spread over tasks.
    """
    s = scores.withColumn("conf", F.array_max("probs")).withColumn("_neg", -F.col("conf"))
    sizes = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("top_conf"))
    ranked = row_numbers(s, list(keys), "_neg", "_rn", ("w_idx",), _CONF)
    limit = F.greatest(F.lit(1).cast("bigint"), half_even(F.lit(frac) * F.col("n")))
    return ranked.join(sizes, list(keys)).withColumn("in_top", F.col("_rn") <= limit).drop("_neg", "_rn")


def pool_windows(
    scores: DataFrame, n_classes: int, how: Sequence[str] = RULES, topk_frac: float = 0.25, temp: float = 1.0,
    keys: Sequence[str] = ("run_id", "clip_id"),
) -> DataFrame:
    """One probability vector per clip and pooling rule.

    All rules come out of a single aggregation by clip. Output: keys, rule, probs.
    """
    s = scores
    if "topk" in how:
        s = top_windows(scores, topk_frac, keys)
    elif "attn" in how:
        s = scores.withColumn("conf", F.array_max("probs"))
        s = s.join(s.groupBy(*keys).agg(F.max("conf").alias("top_conf")), list(keys))
    weight = F.exp((F.col("conf") - F.col("top_conf")) / F.lit(max(temp, 1e-6)))
    p = lambda i: F.get(F.col("probs"), F.lit(i))
    vector = lambda f: F.array(*[f(i) for i in range(n_classes)])
    rules = {
        "mean": lambda i: F.avg(p(i)),
        "max": lambda i: F.max(p(i)),
        "topk": lambda i: F.avg(F.when(F.col("in_top"), p(i))),
        "logmean": lambda i: F.exp(F.avg(F.log(F.least(F.greatest(p(i), F.lit(1e-9)), F.lit(1.0))))),
        "attn": lambda i: F.sum(p(i) * weight) / F.sum(weight),
    }
    pooled = s.groupBy(*keys).agg(*[vector(rules[r]).alias(r) for r in how])
    return pooled.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _normed(F.col(r)).alias("probs")) for r in how])).alias("_r")
    ).select(*keys, "_r.rule", "_r.probs")


def rescore_rules(
    scores: DataFrame, clips: DataFrame, n_classes: int, how: Sequence[str] = RULES, run: str = "run_id",
    clip: str = "clip_id", **options,
) -> DataFrame:
    """Metrics of every pooling rule for every run from stored posteriors."""
    pooled = pool_windows(scores, n_classes, how, keys=(run, clip), **options).withColumn("pred", argmax(F.col("probs")))
    return classification_report(pooled.join(clips.select(clip, "y"), clip), (run, "rule"))


def best_rule(report: DataFrame, metric: str = "balanced_accuracy", run: str = "run_id") -> DataFrame:
    """Winning rule of each run, rule order breaks ties."""
    order = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    return report.groupBy(run).agg(F.max_by("rule", F.struct(F.round(metric, 9), -order)).alias("rule"))


def rule_tally(report: DataFrame, metric: str = "balanced_accuracy", run: str = "run_id") -> DataFrame:
    """How often each rule wins, and its metric averaged over runs."""
    wins = best_rule(report, metric, run).groupBy("rule").agg(F.count(F.lit(1)).alias("wins"))
    means = report.groupBy("rule").agg(F.avg(metric).alias("mean_metric"), F.count(F.lit(1)).alias("runs"))
    return means.join(wins, "rule", "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
