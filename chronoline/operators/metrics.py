"""Classification metrics as closed forms over one confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronoline.functions.numbers import ratio


def confusion_cells(pred: DataFrame, keys: Sequence[str] = ("run_id",), weight: str | None = None) -> DataFrame:
    """Counts per (keys, y, pred): the only pass over predictions any metric needs."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return pred.groupBy(*keys, "y", "pred").agg(n.cast("bigint").alias("n"))


def _class_range(n_classes: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n_classes - 1))


def confusion_matrix(pred: DataFrame, n_classes: int, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Dense K x K counts and row shares (row sum floored at 1)."""
    cells = confusion_cells(pred, keys)
    grid = (
        cells.select(*keys).distinct()
        .withColumn("y", F.explode(_class_range(n_classes)))
        .withColumn("pred", F.explode(_class_range(n_classes)))
    )
    dense = grid.join(cells, [*keys, "y", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = cells.groupBy(*keys, "y").agg(F.sum("n").alias("_row"))
    return dense.join(rows, [*keys, "y"], "left").withColumn(
        "share", F.col("n") / F.greatest(F.coalesce("_row", F.lit(0)), F.lit(1))
    ).drop("_row")


def per_class(
    cells: DataFrame, keys: Sequence[str] = ("run_id",), n_classes: int | None = None
) -> DataFrame:
    """Precision, recall, F1 and support of each class.

    With ``n_classes`` every declared class gets a row; without, only classes that
    occur as label or prediction do.
    """
    sides = cells.select(
        *keys, "n",
        F.explode(F.array(
            F.struct(F.col("y").cast("int").alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p")),
            F.struct(F.col("pred").cast("int").alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p")),
        )).alias("_s"),
        (F.col("y") == F.col("pred")).cast("int").alias("_hit"),
    )
    sums = sides.groupBy(*keys, F.col("_s.cls").alias("cls")).agg(
        F.sum(F.col("n") * F.col("_s.t")).alias("support"),
        F.sum(F.col("n") * F.col("_s.p")).alias("predicted"),
        F.sum(F.col("n") * F.col("_s.t") * F.col("_hit")).alias("tp"),
    )
    if n_classes is not None:
        grid = cells.select(*keys).distinct().withColumn("cls", F.explode(_class_range(n_classes)))
        sums = grid.join(sums, [*keys, "cls"], "left").na.fill(0, ["support", "predicted", "tp"])
    return sums.select(
        *keys, "cls", "support", "predicted", "tp",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def summarise_classes(classes: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted scores, and MCC."""
    d = lambda c: F.col(c).cast("double")
    n, hit = F.sum(d("support")), F.sum(d("tp"))
    cov_yp = hit * n - F.sum(d("support") * d("predicted"))
    cov_yy = n * n - F.sum(d("support") * d("support"))
    cov_pp = n * n - F.sum(d("predicted") * d("predicted"))
    return classes.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        ratio(hit, n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(d("f1") * d("support")), n).alias("weighted_f1"),
        F.when((cov_yy > 0) & (cov_pp > 0), cov_yp / F.sqrt(cov_yy * cov_pp)).otherwise(F.lit(0.0)).alias("mcc"),
    )


def classification_report(
    pred: DataFrame, keys: Sequence[str] = ("run_id",), classes: str = "present", n_classes: int | None = None
) -> DataFrame:
    """Whole-run metrics. ``classes`` = "present" averages over classes that occur as
    label or prediction; "declared" averages over range(n_classes) (A14, A15)."""
    declared = n_classes if classes == "declared" else None
    return summarise_classes(per_class(confusion_cells(pred, keys), keys, declared), keys)


def positive_report(pred: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Precision, recall and F1 of class 1 with accuracy."""
    cells = confusion_cells(pred, keys)
    one = per_class(cells, keys, 2).filter(F.col("cls") == 1).select(*keys, "support", "precision", "recall", "f1")
    acc = summarise_classes(per_class(cells, keys, 2), keys).select(*keys, "n", "accuracy")
    return one.join(acc, list(keys))


def grouped_report(
    pred: DataFrame, run: str = "run_id", group: str = "subject", n_classes: int = 2
) -> DataFrame:
    """Metrics of every (run, group) and of the whole run (group null) in one pass.

    Predictions are counted once; the roll-up works on the counts.
    """
    cells = pred.groupBy(run, group, "y", "pred").agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(
        run, "y", "pred", "n",
        F.explode(F.array(
            F.struct(F.lit(0).alias("whole"), F.col(group).alias("g")),
            F.struct(F.lit(1).alias("whole"), F.lit(None).cast(pred.schema[group].dataType).alias("g")),
        )).alias("_g"),
    ).select(run, "_g.*", "y", "pred", "n").groupBy(run, "whole", F.coalesce(F.col("g").cast("string"), F.lit("")).alias("_k"),
                                                   "g", "y", "pred").agg(F.sum("n").alias("n"))
    keys = [run, "whole", "_k"]
    rep = summarise_classes(per_class(both, keys), keys)
    sup = per_class(both, keys, n_classes).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cls", "support"))), lambda s: s["support"]).alias("support"),
    )
    names = both.groupBy(*keys).agg(F.max("g").alias(group))
    return rep.join(sup, keys).join(names, keys).drop("_k")


def ordinal_errors(pred: DataFrame, keys: Sequence[str] = ("run_id",), n_classes: int = 5) -> DataFrame:
    """Mean distance over errors and the share of each distance that ``n_classes`` allow."""
    cells = confusion_cells(pred, keys)
    d = F.abs(F.col("y") - F.col("pred"))
    wrong = F.when(d > 0, F.col("n"))
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(wrong), F.lit(0)).alias("n_err"),
        ratio(F.sum(d * F.col("n")), F.sum(wrong)).alias("mean_dist"),
        *[
            ratio(F.coalesce(F.sum(F.when((d == k) & (d > 0), F.col("n"))), F.lit(0)), F.sum(wrong)).alias(f"share_{k}")
            for k in range(n_classes)
        ],
    )


def ordinal_suite(pred: DataFrame, n_classes: int, keys: Sequence[str] = ("run_id",), event_floor: int = 1) -> DataFrame:
    """MAE, quadratic kappa and rate of distance >= 2 on true events."""
    cells = confusion_cells(pred.filter(F.col("y") >= event_floor), keys)
    d = F.abs(F.col("y") - F.col("pred")).cast("double")
    n = F.sum("n").cast("double")
    # quadratic weights need only first and second moments of the two marginals
    moment = lambda c, p: F.sum(F.pow(F.col(c).cast("double"), F.lit(p)) * F.col("n"))
    observed = F.sum(d * d * F.col("n")) / n
    expected = (moment("y", 2.0) + moment("pred", 2.0)) / n - 2 * (moment("y", 1.0) / n) * (moment("pred", 1.0) / n)
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(d * F.col("n")) / n).alias("mae"),
        F.when(expected > 0, 1 - observed / expected).alias("quadratic_kappa"),
        ratio(F.coalesce(F.sum(F.when(d >= 2, F.col("n"))), F.lit(0)), n).alias("rate_far"),
    )


def paired_runs(pred: DataFrame, run_a: int, run_b: int, key: str = "clip", carry: Sequence[str] = ()) -> DataFrame:
    """Two runs side by side on the clips they share."""
    a = pred.filter(F.col("run_id") == run_a).select(key, F.col("y"), F.col("pred").alias("pred_a"), *carry)
    b = pred.filter(F.col("run_id") == run_b).select(key, F.col("y").alias("y_b"), F.col("pred").alias("pred_b"))
    return a.join(b, key)


def pairing_audit(pred: DataFrame, run_a: int, run_b: int, key: str = "clip") -> DataFrame:
    """Sizes of both sides, of the overlap, and label disagreements in it."""
    side = lambda r: F.max((F.col("run_id") == r).cast("int"))
    lab = lambda r: F.max(F.when(F.col("run_id") == r, F.col("y")))
    per = pred.filter(F.col("run_id").isin(run_a, run_b)).groupBy(key).agg(
        side(run_a).alias("a"), side(run_b).alias("b"), lab(run_a).alias("ya"), lab(run_b).alias("yb")
    )
    both = (F.col("a") == 1) & (F.col("b") == 1)
    agg = per.agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.count_if(both).alias("n_shared"),
        F.count_if(both & (F.col("ya") != F.col("yb"))).alias("n_label_conflicts"),
    )
    paired = (F.col("n_label_conflicts") == 0) & (F.col("n_shared") == F.col("n_a")) & (F.col("n_shared") == F.col("n_b"))
    return agg.withColumn("pairable", paired).withColumn("large_enough", F.col("n_shared") >= 100)


def paired_outcomes(pred: DataFrame, run_a: int, run_b: int, key: str = "clip") -> DataFrame:
    """Both / A only / B only / neither, overall (y null) and per true class."""
    j = paired_runs(pred, run_a, run_b, key)
    ok_a, ok_b = F.col("pred_a") == F.col("y"), F.col("pred_b") == F.col("y_b")
    return j.rollup("y").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok_a & ok_b).alias("both"), F.count_if(ok_a & ~ok_b).alias("a_only"),
        F.count_if(~ok_a & ok_b).alias("b_only"), F.count_if(~ok_a & ~ok_b).alias("neither"),
    )
