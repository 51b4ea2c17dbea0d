"""Tables over experiment runs: seeds, completeness, comparison and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from chronoline.operators.blocks import Blocks, Run, row_numbers, running

_SCORES = Blocks(width=0.01)


def seed_summary(metrics: DataFrame, by: Sequence[str] = ("arch", "task"), value: str = "value") -> DataFrame:
    """Mean, sample sd (0 for one run), range and count; NaN counts as missing."""
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    return metrics.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"),
        F.min(v).alias("lo"), F.max(v).alias("hi"),
    )


def mark_collapsed(metrics: DataFrame, gap: float = 0.15, by: Sequence[str] = ("arch", "task"), value: str = "value") -> DataFrame:
    """Flag runs more than ``gap`` below their cell's median."""
    med = metrics.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("cell_median"))
    return metrics.join(med, list(by)).withColumn("collapsed", F.col("cell_median") - F.col(value) > F.lit(gap))


def drop_collapsed(metrics: DataFrame, gap: float = 0.15, by: Sequence[str] = ("arch", "task"), value: str = "value") -> DataFrame:
    return mark_collapsed(metrics, gap, by, value).filter(~F.col("collapsed")).drop("collapsed", "cell_median")


def missing_cells(
    metrics: DataFrame, tasks: Sequence[int], min_n: int = 5, arch: str = "arch", task: str = "task"
) -> DataFrame:
    """Cells of the expected grid with fewer than ``min_n`` runs."""
    grid = metrics.select(arch).distinct().withColumn(task, F.explode(F.array(*[F.lit(t) for t in tasks])))
    n = metrics.groupBy(arch, task).agg(F.count(F.lit(1)).alias("n"))
    j = grid.withColumn(task, F.col(task).cast(metrics.schema[task].dataType)).join(n, [arch, task], "left")
    return j.withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < min_n)


def completed(metrics: DataFrame, markers: DataFrame, run: Sequence[str] = ("arch", "task", "seed")) -> DataFrame:
    """Runs whose completion marker exists."""
    return metrics.join(markers.select(*run), list(run), "left_semi")


def first_location(runs: DataFrame, by: Sequence[str], priority: str) -> DataFrame:
    """One row per run: the location that comes first."""
    keep = [c for c in runs.columns if c not in by]
    best = runs.groupBy(*by).agg(F.min_by(F.struct(*keep), F.col(priority)).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in keep])


def best_marks(means: DataFrame, by: Sequence[str] = ("task",), value: str = "mean", item: str = "arch", near: float = 5e-4) -> DataFrame:
    """Best and second per column; a pair closer than ``near`` stays unmarked."""
    neg = means.withColumn("_neg", -F.col(value))
    ranked = running(
        neg, list(by), "_neg",
        [Run("_rn", "sum", F.lit(1).cast("bigint")), Run("_next", "nearest", F.col(value), "after")], (item,), _SCORES,
    )
    top = ranked.filter(F.col("_rn") <= 2)
    tie = top.filter(F.col("_rn") == 1).select(*by, (F.col(value) - F.col("_next") < near).alias("_tie"))
    mark = F.when(F.coalesce("_tie", F.lit(False)), F.lit("none")).when(F.col("_rn") == 1, "best").otherwise("second")
    return top.join(tie, list(by)).select(*by, item, value, mark.alias("mark"))


def best_config(metrics: DataFrame, by: Sequence[str], config: Sequence[str], value: str = "value") -> DataFrame:
    """Configuration with the highest metric per group, smallest configuration on ties."""
    # max_by on (value, then smallest config): rank configs downwards by negating numbers
    best = metrics.groupBy(*by).agg(
        F.max_by(F.struct(*config, value), F.struct(F.col(value), *[-F.col(c) for c in config])).alias("_b")
    )
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in (*config, value)])


def best_checkpoint(epochs: DataFrame, by: Sequence[str], epoch: str, value: str) -> DataFrame:
    """First epoch reaching the run's maximum."""
    return best_config(epochs, by, (epoch,), value)


def compare_runs(before: DataFrame, after: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """Before / after values of every run and their difference."""
    a = before.select(*on, F.col(value).alias("before"))
    b = after.select(*on, F.col(value).alias("after"))
    return a.join(b, list(on), "full_outer").withColumn("delta", F.col("after") - F.col("before"))


def reproduction_gate(deltas: DataFrame, limit: float = 1e-6) -> DataFrame:
    """Worst absolute delta, unmatched runs, and whether the gate holds (Q03)."""
    return deltas.agg(
        F.max(F.abs("delta")).alias("worst"), F.count_if(F.col("delta").isNull()).alias("unmatched")
    ).withColumn("passed", F.coalesce(F.col("worst") < limit, F.lit(False)) & (F.col("unmatched") == 0))


def completeness_gate(metrics: DataFrame, require: int = 5, by: Sequence[str] = ("task",), group: str = "arch") -> DataFrame:
    """May a table be published: every cell of the group has enough runs (Q06)."""
    n = metrics.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("n") < require).alias("short_cells"),
        (F.min("n") >= require).alias("publishable"),
    )


def spread_ratio(metrics: DataFrame, by: Sequence[str] = ("task",), item: str = "arch", value: str = "value") -> DataFrame:
    """Band of means across models over the median within-model sd."""
    cells = metrics.groupBy(*by, item).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return cells.groupBy(*by).agg(
        (F.max("m") - F.min("m")).alias("band"), F.percentile("s", F.lit(0.5)).alias("median_sd")
    ).withColumn("ratio", F.try_divide("band", "median_sd"))


def modality_gap(metrics: DataFrame, group: str, a, b, by: Sequence[str] = ("task",), value: str = "value") -> DataFrame:
    """Mean of group a minus mean of group b."""
    m = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    return metrics.groupBy(*by).agg(m(a).alias("mean_a"), m(b).alias("mean_b")).withColumn(
        "gap", F.col("mean_a") - F.col("mean_b")
    )


def macro_of_map(results: DataFrame, field: str, classes: str = "per_class") -> DataFrame:
    """Average of one field over a map of per-class structs."""
    vals = F.map_values(F.col(classes))
    total = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v[field])
    return results.withColumn(f"macro_{field}", F.try_divide(total, F.size(vals).cast("double")))
