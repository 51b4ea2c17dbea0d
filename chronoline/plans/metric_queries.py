"""Queries over predictions, posteriors, clips and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.functions.hashing import mix_sql
from chronoline.functions.numbers import argmax, collapse, r6
from chronoline.operators import metrics as mt, pooling, ranking, runs, splits, stats
from chronoline.operators.blocks import Blocks
from chronoline.plans.catalog import query
from chronoline.plans.event_queries import _round, r6s
from chronoline.session import settle

_METRICS = ("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "mcc")


def report_sql(keys: str, cells: str, declared: int | None = None) -> str:
    """CTEs cls and rep: per-class and whole-run metrics from a table of (keys, y, pred, n)."""
    names = (
        f"SELECT DISTINCT {keys}, CAST(unnest(range({declared})) AS INT) AS c FROM {cells}" if declared
        else f"SELECT {keys}, y AS c FROM {cells} UNION SELECT {keys}, pred FROM {cells}"
    )
    return f"""
names AS ({names}),
cls0 AS (SELECT {keys}, c, coalesce(sum(n) FILTER (y = c), 0)::BIGINT AS support, coalesce(sum(n) FILTER (pred = c), 0)::BIGINT AS predicted,
                coalesce(sum(n) FILTER (y = c AND pred = c), 0)::BIGINT AS tp FROM {cells} JOIN names USING ({keys}) GROUP BY {keys}, c),
cls AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0.0 END AS recall,
               CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted)::DOUBLE ELSE 0.0 END AS f1 FROM cls0),
rep AS (SELECT {keys}, sum(support)::BIGINT AS n, sum(tp) / sum(support)::DOUBLE AS accuracy, avg(recall) FILTER (support > 0) AS balanced_accuracy,
               avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
               sum(f1 * support) / sum(support)::DOUBLE AS weighted_f1,
               CASE WHEN sum(support)::DOUBLE ** 2 - sum(support::DOUBLE * support) > 0 AND sum(support)::DOUBLE ** 2 - sum(predicted::DOUBLE * predicted) > 0
                    THEN (sum(tp)::DOUBLE * sum(support) - sum(support::DOUBLE * predicted))
                         / sqrt((sum(support)::DOUBLE ** 2 - sum(support::DOUBLE * support)) * (sum(support)::DOUBLE ** 2 - sum(predicted::DOUBLE * predicted)))
                    ELSE 0.0 END AS mcc FROM cls GROUP BY {keys})"""


CELLS = "cells AS (SELECT run_id, y, pred, count(*) AS n FROM prediction GROUP BY ALL)"
PRED5 = """
meanp AS (SELECT run_id, clip_id, k, avg(p) AS p FROM posterior GROUP BY ALL),
pred5 AS (SELECT m.run_id, m.clip_id AS clip, any_value(c.subject) AS subject, any_value(c.y) AS y, arg_max(k, (p, -k)) AS pred
          FROM meanp m JOIN clip c USING (clip_id) GROUP BY m.run_id, m.clip_id)"""
CELLS5 = "cells AS (SELECT run_id, y, pred, count(*) AS n FROM pred5 GROUP BY ALL)"
P5 = ("posterior", "clip")


def window_probs(s):
    """Posterior vectors, one row per run and window."""
    packed = s.posterior.groupBy("run_id", "clip_id", "w_idx").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("a"))
    return packed.select("run_id", "clip_id", "w_idx", F.transform("a", lambda x: x["p"]).alias("probs"))


def pred5(s):
    pooled = pooling.pool_windows(window_probs(s), 5, ("mean",)).withColumn("pred", argmax(F.col("probs")))
    return pooled.join(s.clip, "clip_id").select("run_id", F.col("clip_id").alias("clip"), "subject", "y", "pred", "probs")


@query("confusion_matrix", f"""
WITH {PRED5}, {CELLS5}, g AS (SELECT DISTINCT run_id, CAST(unnest(range(5)) AS INT) AS y FROM cells), g2 AS (SELECT *, CAST(unnest(range(5)) AS INT) AS pred FROM g)
SELECT run_id, y, pred, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(coalesce(sum(n) OVER (PARTITION BY run_id, y), 0), 1)::DOUBLE, 6) AS share
FROM g2 LEFT JOIN cells USING (run_id, y, pred)""", P5)
def _(s):
    return _round(mt.confusion_matrix(pred5(s), 5), "share")


@query("per_class_scores", f"WITH {PRED5}, {CELLS5}, {report_sql('run_id', 'cells', 5)} "
       f"SELECT run_id, c AS cls, support, {r6s('precision', 'recall', 'f1')} FROM cls", P5)
def _(s):
    out = mt.per_class(mt.confusion_cells(pred5(s)), n_classes=5).select("run_id", "cls", "support", "precision", "recall", "f1")
    return _round(out, "precision", "recall", "f1")


@query("classification_report", f"WITH {CELLS}, {report_sql('run_id', 'cells')} SELECT run_id, n, {r6s(*_METRICS)} FROM rep", ("prediction",))
def _(s):
    return _round(mt.classification_report(s.prediction), *_METRICS)


@query("classification_report_declared", f"WITH {PRED5}, {CELLS5}, {report_sql('run_id', 'cells', 5)} SELECT run_id, n, {r6s(*_METRICS)} FROM rep", P5)
def _(s):
    return _round(mt.classification_report(pred5(s), classes="declared", n_classes=5), *_METRICS)


@query("mcc", f"WITH {PRED5}, {CELLS5}, {report_sql('run_id', 'cells')} SELECT run_id, round(mcc, 6) + 0.0 AS mcc FROM rep", P5)
def _(s):
    return _round(mt.classification_report(pred5(s)).select("run_id", "mcc"), "mcc")


@query("collapsed_classes_report", f"""
WITH {PRED5}, three AS (SELECT run_id, CASE WHEN y = 0 THEN 0 WHEN y <= 2 THEN 1 ELSE 2 END AS y,
     CASE WHEN pred = 0 THEN 0 WHEN pred <= 2 THEN 1 ELSE 2 END AS pred FROM pred5),
cells AS (SELECT run_id, y, pred, count(*) AS n FROM three GROUP BY ALL), {report_sql('run_id', 'cells')}
SELECT run_id, {r6s('accuracy', 'macro_f1')} FROM rep""", P5)
def _(s):
    p = pred5(s).select("run_id", collapse(F.col("y"), 3).alias("y"), collapse(F.col("pred"), 3).alias("pred"))
    return _round(mt.classification_report(p).select("run_id", "accuracy", "macro_f1"), "accuracy", "macro_f1")


@query("positive_class_report", f"""
WITH {CELLS}, {report_sql('run_id', 'cells', 2)}
SELECT run_id, c.support, {r6s('c.precision', 'c.recall', 'c.f1', 'accuracy')}, rep.n FROM cls c JOIN rep USING (run_id) WHERE c.c = 1""", ("prediction",))
def _(s):
    return _round(mt.positive_report(s.prediction), "precision", "recall", "f1", "accuracy")


@query("per_subject_report", f"""
WITH cells AS (SELECT run_id, 0 AS whole, subject, y, pred, count(*) AS n FROM prediction GROUP BY ALL
               UNION ALL SELECT run_id, 1, -1, y, pred, count(*) FROM prediction GROUP BY ALL), {report_sql('run_id, whole, subject', 'cells')}
SELECT run_id, whole, nullif(subject, -1) AS subject, n, {r6s('accuracy', 'macro_f1')},
       (SELECT coalesce(sum(n), 0) FROM cells x WHERE x.run_id = rep.run_id AND x.whole = rep.whole AND x.subject = rep.subject AND y = 0)::BIGINT AS support_0,
       (SELECT coalesce(sum(n), 0) FROM cells x WHERE x.run_id = rep.run_id AND x.whole = rep.whole AND x.subject = rep.subject AND y = 1)::BIGINT AS support_1
FROM rep""", ("prediction",))
def _(s):
    out = mt.grouped_report(s.prediction, n_classes=2).select(
        "run_id", "whole", "subject", "n", "accuracy", "macro_f1", F.get("support", F.lit(0)).alias("support_0"),
        F.get("support", F.lit(1)).alias("support_1"))
    return _round(out, "accuracy", "macro_f1")


@query("auroc_binary", """
WITH c AS (SELECT run_id, score, sum(y) AS pos, sum(1 - y) AS neg FROM prediction GROUP BY ALL),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY run_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT run_id, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auroc FROM r GROUP BY run_id""", ("prediction",))
def _(s):
    return _round(ranking.auroc(s.prediction), "auroc")


_OVR = """
ovr AS (SELECT run_id, k, p, CASE WHEN y = k THEN 1 ELSE 0 END AS y FROM scored),
c AS (SELECT run_id, k, p, sum(y) AS pos, sum(1 - y) AS neg FROM ovr GROUP BY ALL),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY run_id, k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT run_id, k, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auroc FROM r GROUP BY run_id, k)"""


def _long_probs(s):
    # twelve digits: equal scores must tie on both engines
    p = settle(pred5(s))
    return p.select("run_id", F.col("clip").alias("clip_id"), "y", F.posexplode("probs").alias("k", "p")).withColumn("p", F.round("p", 12))


@query("auroc_one_vs_rest", f"""
WITH m AS (SELECT run_id, clip_id, k, avg(p) AS p FROM posterior GROUP BY ALL),
scored AS (SELECT run_id, clip_id, k, y, round(p / sum(p) OVER (PARTITION BY run_id, clip_id), 12) AS p FROM m JOIN clip USING (clip_id)), {_OVR}
SELECT run_id, CASE WHEN count(auroc) = 5 THEN round(avg(auroc), 6) END AS auroc FROM a GROUP BY run_id""", P5)
def _(s):
    return _round(ranking.auroc_ovr(_long_probs(s)), "auroc")


@query("auroc_present_classes", f"""
WITH m AS (SELECT run_id, clip_id, k, avg(p) AS p FROM posterior GROUP BY ALL),
s0 AS (SELECT run_id, clip_id, k, y, round(p / sum(p) OVER (PARTITION BY run_id, clip_id), 12) AS p FROM m JOIN clip USING (clip_id)),
s1 AS (SELECT s0.* FROM s0 WHERE y <> 1 AND k IN (SELECT DISTINCT y FROM s0 WHERE y <> 1)),
scored AS (SELECT run_id, clip_id, k, y, p / sum(p) OVER (PARTITION BY run_id, clip_id) AS p FROM s1), {_OVR}
SELECT run_id, round(avg(auroc), 4) AS auroc FROM a GROUP BY run_id""", P5)
def _(s):
    p = _long_probs(s).filter(F.col("y") != 1)
    return ranking.auroc_ovr(p, present_only=True).select("run_id", F.round("auroc", 4).alias("auroc"))


@query("average_precision", """
WITH c AS (SELECT run_id, score, sum(y) AS pos, sum(1 - y) AS neg FROM prediction GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c WINDOW w AS (PARTITION BY run_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT run_id, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM r GROUP BY run_id""", ("prediction",))
def _(s):
    return _round(ranking.average_precision(s.prediction), "average_precision")


@query("attribute_leakage", """
WITH m AS (SELECT CASE WHEN path LIKE '%/seizure_%' THEN 1 ELSE 0 END AS y, length::DOUBLE AS length, length(path)::DOUBLE AS path_length FROM manifest),
l AS (SELECT y, 'length' AS attribute, length AS v FROM m UNION ALL SELECT y, 'path_length', path_length FROM m),
c AS (SELECT attribute, v, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY ALL),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY attribute ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT attribute, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc FROM r GROUP BY attribute)
SELECT attribute, round(auroc, 6) AS auroc, auroc >= 0.99 OR auroc <= 0.01 AS leaks FROM a""", ("manifest",))
def _(s):
    m = s.manifest.select(F.col("path").contains("/seizure_").cast("int").alias("y"), "length", F.length("path").alias("path_length"))
    return _round(ranking.attribute_leakage(m, ["length", "path_length"]), "auroc")


@query("ordinal_errors", f"""
WITH {PRED5}, e AS (SELECT *, abs(y - pred) AS d FROM pred5)
SELECT run_id, count(*) AS n, count(*) FILTER (d > 0) AS n_err, round(coalesce(avg(d) FILTER (d > 0), 0.0), 6) AS mean_dist,
       0.0 AS share_0, {", ".join(f"round(CASE WHEN count(*) FILTER (d > 0) > 0 THEN count(*) FILTER (d = {k}) / (count(*) FILTER (d > 0))::DOUBLE ELSE 0.0 END, 6) AS share_{k}" for k in range(1, 5))}
FROM e GROUP BY run_id""", P5)
def _(s):
    return _round(mt.ordinal_errors(pred5(s)), "mean_dist", *[f"share_{k}" for k in range(5)])


@query("ordinal_suite", f"""
WITH {PRED5}, e AS (SELECT run_id, y, pred FROM pred5 WHERE y >= 1),
o AS (SELECT run_id, count(*) AS n, avg(abs(y - pred)) AS mae, avg((y - pred) ** 2) AS obs, avg(CASE WHEN abs(y - pred) >= 2 THEN 1.0 ELSE 0.0 END) AS rate_far FROM e GROUP BY run_id),
x AS (SELECT a.run_id, avg((a.y - b.pred) ** 2) AS exp FROM e a JOIN e b ON a.run_id = b.run_id GROUP BY a.run_id)
SELECT run_id, n, round(mae, 6) AS mae, round(1 - obs / exp, 6) AS quadratic_kappa, round(rate_far, 6) AS rate_far FROM o JOIN x USING (run_id)""", P5)
def _(s):
    return _round(mt.ordinal_suite(pred5(s), 5), "mae", "quadratic_kappa", "rate_far")


@query("paired_outcomes", """
WITH j AS (SELECT a.clip, a.y, a.pred = a.y AS ok_a, b.pred = b.y AS ok_b FROM prediction a JOIN prediction b ON a.clip = b.clip WHERE a.run_id = 1 AND b.run_id = 2)
SELECT y, count(*) AS n, count(*) FILTER (ok_a AND ok_b) AS both, count(*) FILTER (ok_a AND NOT ok_b) AS a_only,
       count(*) FILTER (NOT ok_a AND ok_b) AS b_only, count(*) FILTER (NOT ok_a AND NOT ok_b) AS neither FROM j GROUP BY ROLLUP(y)""", ("prediction",))
def _(s):
    return mt.paired_outcomes(s.prediction, 1, 2)


@query("pairing_audit", """
WITH a AS (SELECT * FROM prediction WHERE run_id = 1), b AS (SELECT clip, CASE WHEN score > 0.2 THEN y ELSE 1 - y END AS y FROM prediction WHERE run_id = 3 AND pred = 1)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(*) AS n_shared, count(*) FILTER (a.y <> b.y) AS n_label_conflicts,
       count(*) FILTER (a.y <> b.y) = 0 AND count(*) = (SELECT count(*) FROM a) AND count(*) = (SELECT count(*) FROM b) AS pairable, count(*) >= 100 AS large_enough
FROM a JOIN b ON a.clip = b.clip""", ("prediction",))
def _(s):
    p = s.prediction
    b = p.filter("run_id = 3 AND pred = 1").withColumn("y", F.when(F.col("score") > 0.2, F.col("y")).otherwise(1 - F.col("y")))
    return mt.pairing_audit(p.filter("run_id = 1").unionByName(b), 1, 3)


_MC = """
WITH j AS (SELECT a.run_id AS run_a, b.run_id AS run_b, a.pred = a.y AS ok_a, b.pred = b.y AS ok_b, a.y <> b.y AS conflict
           FROM prediction a JOIN prediction b ON a.clip = b.clip AND a.run_id < b.run_id),
n AS (SELECT run_a, run_b, count(*) AS n, count(*) FILTER (ok_a AND NOT ok_b) AS a_only, count(*) FILTER (NOT ok_a AND ok_b) AS b_only,
             count(*) FILTER (conflict) AS label_conflicts FROM j GROUP BY run_a, run_b),
t AS (SELECT *, CASE WHEN a_only = b_only THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
      lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))) END AS p FROM n)
"""


@query("mcnemar", _MC + "SELECT a_only, b_only, round(p, 6) AS p FROM t WHERE run_a = 1 AND run_b = 2", ("prediction",))
def _(s):
    return _round(stats.mcnemar(s.prediction, 1, 2), "p")


@query("pairwise_mcnemar", _MC + "SELECT run_a, run_b, n, a_only, b_only, label_conflicts, round(p, 6) AS p FROM t", ("prediction",))
def _(s):
    return _round(stats.pairwise_mcnemar(s.prediction), "p")


@query("null_calibration", _MC + f", {CELLS}, {report_sql('run_id', 'cells')}" + """
SELECT count(*) AS pairs, count(*) FILTER (p < 0.05) AS significant, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share,
       (SELECT round(avg(macro_f1), 6) FROM rep) AS mean_f1, (SELECT round(stddev_samp(macro_f1), 6) FROM rep) AS sd_f1,
       (SELECT round(min(macro_f1), 6) FROM rep) AS min_f1, (SELECT round(max(macro_f1), 6) FROM rep) AS max_f1 FROM t""", ("prediction",))
def _(s):
    return _round(stats.null_calibration(s.prediction), "share", "mean_f1", "sd_f1", "min_f1", "max_f1")


N_REP = 2000


# a binomial count by inverse sums from the seeded uniform u: n trials left, share c of what is left of the weight t
_BINOMIAL = """CASE WHEN c = t THEN n WHEN n = 0 THEN 0 ELSE list_reduce(
    list_transform(range(lo, hi), lambda k: {'total': 0.0::DOUBLE, 'term': 0.0::DOUBLE, 'x': k}),
    lambda a, e: {'total': a.total + a.term, 'term': a.term * (n - e.x) / (e.x + 1) * p / (1 - p), 'x': CASE WHEN u >= a.total + a.term THEN e.x + 1 ELSE a.x END},
    {'total': 0.0::DOUBLE, 'term': exp(lgamma(n + 1) - lgamma(lo + 1) - lgamma(n - lo + 1) + lo * ln(p) + (n - lo) * ln(1 - p)), 'x': lo}).x END"""


def _boot_sql(runs_: str, fields: str, side_rows: str, tail: str) -> str:
    """Multinomial resamples of the cells of ``runs_``, cell after cell."""
    u = f"{mix_sql('i', '0 + rep * 7919 + 1')} / 2147483647.0::DOUBLE"
    return f"""
WITH RECURSIVE {runs_},
c0 AS (SELECT {fields}, count(*) AS c FROM base GROUP BY ALL), c1 AS (SELECT *, row_number() OVER (ORDER BY {fields}) - 1 AS i FROM c0),
d AS (
    SELECT rep, -1::BIGINT AS i, 0::BIGINT AS x, (SELECT sum(c) FROM c1)::BIGINT AS n, (SELECT sum(c) FROM c1)::BIGINT AS t FROM range({N_REP}) r(rep)
    UNION ALL
    SELECT rep, i, x, (n - x)::BIGINT, (t - c)::BIGINT FROM (
        SELECT *, {_BINOMIAL} AS x FROM (
            SELECT *, greatest(0, floor(n * p - spread))::BIGINT AS lo, least(n, ceil(n * p + spread))::BIGINT AS hi FROM (
                SELECT *, sqrt(n * p * (1 - p)) * 10 + 20 AS spread FROM (
                    SELECT d.rep, c1.i, c1.c, d.n, d.t, c1.c / d.t::DOUBLE AS p, {u.replace('(i AS', '(c1.i AS')} AS u FROM d d JOIN c1 c1 ON c1.i = d.i + 1))))),
res AS (SELECT rep, {fields}, x AS n FROM d JOIN c1 USING (i) WHERE x > 0),
{side_rows}, {tail}"""


_DIFFERENCE = _boot_sql(
    "base AS (SELECT a.y, a.pred AS pred_a, b.pred AS pred_b FROM prediction a JOIN prediction b ON a.clip = b.clip WHERE a.run_id = 1 AND b.run_id = 2)",
    "y, pred_a, pred_b",
    "cells AS (SELECT rep, 1 AS side, y, pred_a AS pred, sum(n)::BIGINT AS n FROM res GROUP BY ALL UNION ALL SELECT rep, -1, y, pred_b, sum(n)::BIGINT FROM res GROUP BY ALL)",
    report_sql("rep, side", "cells") + ", df AS (SELECT rep, sum(macro_f1 * side) AS d FROM rep GROUP BY rep) "
    "SELECT round(avg(d), 6) AS mean_diff, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM df")


@query("bootstrap_difference", _DIFFERENCE, ("prediction",))
def _(s):
    return _round(stats.bootstrap_diff(s.prediction, 1, 2, n=N_REP, seed=0), "mean_diff", "lo", "hi")


@query("bootstrap_difference_multinomial", _DIFFERENCE, ("prediction",))
def _(s):
    return _round(stats.bootstrap_diff(s.prediction, 1, 2, n=N_REP, seed=0), "mean_diff", "lo", "hi")


def _interval_sql(run: int) -> str:
    return _boot_sql(
        f"base AS (SELECT y, pred FROM prediction WHERE run_id = {run})", "y, pred", "cells AS (SELECT rep, y, pred, n FROM res)",
        report_sql("rep", "cells") + f" SELECT {run} AS run_id, round(avg(macro_f1), 6) AS mean, round(quantile_cont(macro_f1, 0.025), 6) AS lo, "
        "round(quantile_cont(macro_f1, 0.975), 6) AS hi FROM rep")


@query("bootstrap_interval", _interval_sql(1), ("prediction",))
def _(s):
    return _round(stats.bootstrap_interval(s.prediction, 1, n=N_REP), "mean", "lo", "hi")


@query("bootstrap_overlap", f"""
SELECT a.run_id AS run_a, a.lo AS lo_a, a.hi AS hi_a, b.run_id AS run_b, b.lo AS lo_b, b.hi AS hi_b, NOT (a.lo > b.hi OR b.lo > a.hi) AS overlap
FROM ({_interval_sql(1)}) a, ({_interval_sql(2)}) b""", ("prediction",))
def _(s):
    p = s.prediction
    return _round(stats.intervals_overlap(stats.bootstrap_interval(p, 1), stats.bootstrap_interval(p, 2)), "lo_a", "hi_a", "lo_b", "hi_b")


_COV = "cov AS (SELECT doc_id AS clip, n_chars::DOUBLE AS dur FROM documents)"
_JCOV = f"""
WITH {_COV}, j AS (SELECT a.clip, a.y, a.pred = a.y AS ok_a, b.pred = b.y AS ok_b, dur FROM prediction a JOIN prediction b ON a.clip = b.clip
     JOIN cov ON cov.clip = a.clip WHERE a.run_id = 1 AND b.run_id = 2)"""


def _cov(s):
    return s.documents.select(F.col("doc_id").alias("clip"), F.col("n_chars").cast("double").alias("dur"))


@query("medians_by_outcome", _JCOV + """
SELECT count(*) AS n, median(dur) AS median_all, median(dur) FILTER (ok_a) AS a_right, median(dur) FILTER (NOT ok_a) AS a_wrong,
       median(dur) FILTER (ok_b) AS b_right, median(dur) FILTER (NOT ok_b) AS b_wrong FROM j HAVING count(*) > 50""", ("prediction",))
def _(s):
    return stats.medians_by_outcome(s.prediction, _cov(s), 1, 2, "dur")


@query("median_split_recall", _JCOV + """, m AS (SELECT y, median(dur) AS median, count(*) AS n FROM j GROUP BY y HAVING count(*) >= 12)
SELECT y, any_value(n) AS n, any_value(median) AS median, round(avg(CASE WHEN ok_a THEN 1.0 ELSE 0.0 END) FILTER (dur <= median), 6) AS a_low,
       round(avg(CASE WHEN ok_a THEN 1.0 ELSE 0.0 END) FILTER (dur > median), 6) AS a_high,
       round(avg(CASE WHEN ok_b THEN 1.0 ELSE 0.0 END) FILTER (dur <= median), 6) AS b_low,
       round(avg(CASE WHEN ok_b THEN 1.0 ELSE 0.0 END) FILTER (dur > median), 6) AS b_high FROM j JOIN m USING (y) GROUP BY y""", ("prediction",))
def _(s):
    return _round(stats.median_split_recall(s.prediction, _cov(s), 1, 2, "dur"), "a_low", "a_high", "b_low", "b_high")


# ---- pooling --------------------------------------------------------------

POOL_SQL = """
conf AS (SELECT run_id, clip_id, w_idx, max(p) AS conf FROM posterior GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY run_id, clip_id ORDER BY conf DESC, w_idx) AS rn, count(*) OVER (PARTITION BY run_id, clip_id) AS nw,
              max(conf) OVER (PARTITION BY run_id, clip_id) AS top FROM conf),
j AS (SELECT p.*, cr.conf, rn, nw, top FROM posterior p JOIN cr USING (run_id, clip_id, w_idx)),
raw AS (SELECT run_id, clip_id, k, avg(p) AS mean, max(p) AS max, avg(p) FILTER (rn <= greatest(1, round_even(0.25 * nw, 0))) AS topk,
               exp(avg(ln(least(greatest(p, 1e-9), 1.0)))) AS logmean, sum(p * exp(conf - top)) / sum(exp(conf - top)) AS attn FROM j GROUP BY ALL),
long AS (UNPIVOT raw ON mean, max, topk, logmean, attn INTO NAME rule VALUE q),
pooled AS (SELECT run_id, clip_id, rule, k, q / sum(q) OVER (PARTITION BY run_id, clip_id, rule) AS p FROM long)"""


@query("pool_windows", f"WITH {POOL_SQL} SELECT run_id, clip_id, rule, k, round(p, 6) AS p FROM pooled", ("posterior",))
def _(s):
    out = pooling.pool_windows(window_probs(s), 5).select("run_id", "clip_id", "rule", F.posexplode("probs").alias("k", "p"))
    return _round(out, "p")


@query("top_windows", f"WITH {POOL_SQL} SELECT run_id, clip_id, w_idx, rn <= greatest(1, round_even(0.25 * nw, 0)) AS in_top FROM cr", ("posterior",))
def _(s):
    return pooling.top_windows(window_probs(s)).select("run_id", "clip_id", "w_idx", "in_top")


_RESCORE = f"""WITH {POOL_SQL},
pr AS (SELECT run_id, rule, clip_id, arg_max(k, (round(p, 12), -k)) AS pred FROM pooled GROUP BY ALL),
cells AS (SELECT run_id, rule, y, pred, count(*) AS n FROM pr JOIN clip USING (clip_id) GROUP BY ALL), {report_sql('run_id, rule', 'cells')}"""


def _rescored(s):
    return pooling.rescore_rules(window_probs(s), s.clip, 5)


@query("rescore_rules", _RESCORE + f" SELECT run_id, rule, n, {r6s(*_METRICS)} FROM rep", P5)
def _(s):
    return _round(_rescored(s), *_METRICS)


_ORD = "list_position(['mean', 'max', 'topk', 'logmean', 'attn'], rule)"


@query("best_rule_per_run", _RESCORE + f" SELECT run_id, arg_max(rule, (round(balanced_accuracy, 9), -{_ORD})) AS rule FROM rep GROUP BY run_id", P5)
def _(s):
    return pooling.best_rule(_rescored(s))


@query("rule_tally", _RESCORE + f""", b AS (SELECT run_id, arg_max(rule, (round(balanced_accuracy, 9), -{_ORD})) AS rule FROM rep GROUP BY run_id),
w AS (SELECT rule, count(*) AS wins FROM b GROUP BY rule)
SELECT rule, round(avg(balanced_accuracy), 6) AS mean_metric, count(*) AS runs, coalesce(any_value(wins), 0) AS wins FROM rep LEFT JOIN w USING (rule) GROUP BY rule""", P5)
def _(s):
    return _round(pooling.rule_tally(settle(_rescored(s))), "mean_metric")


# ---- splits ---------------------------------------------------------------

def _place(keys: str, ident: str, seed: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"row_number() OVER ({part}ORDER BY {mix_sql(ident, seed)}, {ident})"


SPLIT_SQL = f"""
ses AS (SELECT DISTINCT session FROM clip), tot AS (SELECT greatest(1, round_even(count(*) * 0.2, 0)) AS nv FROM ses),
tries AS (SELECT session, CAST(unnest(range(49, 549)) AS INT) AS split_seed FROM ses),
placed AS (SELECT *, {_place('split_seed', 'session', 'split_seed')} AS place FROM tries),
sides AS (SELECT session, split_seed, place <= (SELECT nv FROM tot) AS is_val FROM placed),
ok AS (SELECT split_seed FROM sides JOIN clip USING (session) GROUP BY split_seed
       HAVING count(DISTINCT y) FILTER (is_val) = 5 AND count(DISTINCT y) FILTER (NOT is_val) = 5),
split AS (SELECT * FROM sides WHERE split_seed = (SELECT min(split_seed) FROM ok))"""


@query("session_split", f"WITH {SPLIT_SQL} SELECT session, is_val, split_seed FROM split", ("clip",))
def _(s):
    return splits.session_split(s.clip)


@query("subject_folds", f"WITH sub AS (SELECT DISTINCT subject FROM clip) SELECT subject, ({_place('', 'subject', '49')} - 1) % 5 AS fold FROM sub", ("clip",))
def _(s):
    return splits.subject_folds(s.clip)


@query("subject_fraction", f"""WITH sub AS (SELECT DISTINCT subject FROM clip), p AS (SELECT subject, {_place('', 'subject', '1049')} AS place FROM sub)
SELECT subject FROM p WHERE place <= (SELECT greatest(1, round_even(count(*) * 0.5, 0)) FROM sub)""", ("clip",))
def _(s):
    return splits.subject_fraction(s.clip, 0.5)


@query("seeded_sample", f"SELECT file_id, path FROM manifest QUALIFY {_place('', 'file_id', '0')} <= 900", ("manifest",))
def _(s):
    return splits.seeded_sample(s.manifest, "file_id", 900).select("file_id", "path")


@query("systematic_sample", "SELECT file_id, path FROM manifest QUALIFY (row_number() OVER (ORDER BY file_id) - 1) % 5 = 0", ("manifest",))
def _(s):
    return splits.systematic_sample(s.manifest, "file_id", 5).select("file_id", "path")


@query("class_counts", f"""WITH {SPLIT_SQL}, g AS (SELECT DISTINCT is_val, CAST(unnest(range(5)) AS INT) AS y FROM split),
n AS (SELECT is_val, y, count(*) AS n FROM clip JOIN split USING (session) GROUP BY ALL) SELECT is_val, y, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (is_val, y)""", ("clip",))
def _(s):
    return splits.class_counts(s.clip.join(settle(splits.session_split(s.clip)), "session"), 5)


@query("class_weights", """WITH g AS (SELECT CAST(unnest(range(5)) AS INT) AS y), n AS (SELECT g.y, greatest(count(c.clip_id), 1) AS n FROM g LEFT JOIN clip c ON c.y = g.y GROUP BY g.y)
SELECT y, round((1.0 / n) / avg(1.0 / n) OVER (), 6) AS weight FROM n""", ("clip",))
def _(s):
    return _round(splits.class_weights(s.clip, 5), "weight")


@query("split_overlap", f"WITH {SPLIT_SQL} SELECT session FROM clip JOIN split USING (session) WHERE is_val INTERSECT SELECT session FROM clip JOIN split USING (session) WHERE NOT is_val", ("clip",))
def _(s):
    return splits.split_overlap(s.clip, settle(splits.session_split(s.clip)), "session")


@query("window_membership", f"""WITH {SPLIT_SQL}
SELECT is_val, subject, w.wlab, count(*) AS n FROM window_v w JOIN clip c USING (clip_id) JOIN split s ON s.session = c.session GROUP BY ALL""", ("clip", "window_v"))
def _(s):
    split = settle(splits.session_split(s.clip))
    per_clip = s.clip.join(split, "session").select("clip_id", "subject", "is_val")
    return s.window_v.join(per_clip, "clip_id").groupBy("is_val", "subject", "wlab").agg(F.count(F.lit(1)).alias("n"))


# ---- run tables -----------------------------------------------------------

@query("seed_summary", """SELECT arch, task, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS sd,
round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM metric GROUP BY arch, task""", ("metric",))
def _(s):
    return _round(runs.seed_summary(s.metric), "mean", "sd", "lo", "hi")


@query("fold_summary", """SELECT task, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS sd,
round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM (SELECT task, CASE WHEN seed = 1 AND task = 2 THEN NULL ELSE value END AS value FROM metric) GROUP BY task""", ("metric",))
def _(s):
    m = s.metric.withColumn("value", F.when((F.col("seed") == 1) & (F.col("task") == 2), F.lit(float("nan"))).otherwise(F.col("value")))
    return _round(runs.seed_summary(m, ("task",)), "mean", "sd", "lo", "hi")


_COLL = "WITH m AS (SELECT *, median(value) OVER (PARTITION BY arch, task) AS med FROM metric)"


@query("collapsed_runs", _COLL + " SELECT arch, task, seed, round(value, 6) AS value, round(med, 6) AS cell_median FROM m WHERE med - value > 0.15", ("metric",))
def _(s):
    out = runs.mark_collapsed(s.metric).filter("collapsed").select("arch", "task", "seed", "value", "cell_median")
    return _round(out, "value", "cell_median")


@query("summary_without_collapsed", _COLL + """ SELECT arch, task, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS sd
FROM m WHERE NOT med - value > 0.15 GROUP BY arch, task""", ("metric",))
def _(s):
    return _round(runs.seed_summary(runs.drop_collapsed(s.metric)).select("arch", "task", "n", "mean", "sd"), "mean", "sd")


@query("missing_cells", """WITH g AS (SELECT DISTINCT arch, unnest([0, 1, 2, 3]) AS task FROM metric), n AS (SELECT arch, task, count(*) AS n FROM metric GROUP BY ALL)
SELECT arch, task, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (arch, task) WHERE coalesce(n, 0) < 5""", ("metric",))
def _(s):
    return runs.missing_cells(s.metric, (0, 1, 2, 3))


_DONE = "done AS (SELECT arch, task, seed FROM metric WHERE seed < 4 OR arch % 2 = 0)"


@query("completed_runs", f"WITH {_DONE} SELECT arch, task, seed, round(value, 6) AS value FROM metric SEMI JOIN done USING (arch, task, seed)", ("metric",))
def _(s):
    done = s.metric.filter("seed < 4 OR arch % 2 = 0")
    return _round(runs.completed(s.metric, done).select("arch", "task", "seed", "value"), "value")


@query("first_location", """WITH u AS (SELECT arch, task, seed, value, 1 AS place FROM metric WHERE seed > 1 UNION ALL SELECT arch, task, seed, value / 2, 2 FROM metric)
SELECT arch, task, seed, round(arg_min(value, place), 6) AS value, min(place) AS place FROM u GROUP BY arch, task, seed""", ("metric",))
def _(s):
    m = s.metric.select("arch", "task", "seed", "value")
    u = m.filter("seed > 1").withColumn("place", F.lit(1)).unionByName(m.withColumn("value", F.col("value") / 2).withColumn("place", F.lit(2)))
    return _round(runs.first_location(u, ("arch", "task", "seed"), "place"), "value")


@query("best_marks", """WITH m AS (SELECT arch, task, round(avg(value), 9) AS mean FROM metric GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(mean) OVER w AS nx FROM m WINDOW w AS (PARTITION BY task ORDER BY mean DESC, arch)),
t AS (SELECT task, mean - nx < 5e-4 AS tie FROM r WHERE rn = 1)
SELECT task, arch, round(mean, 6) AS mean, CASE WHEN coalesce(tie, false) THEN 'none' WHEN rn = 1 THEN 'best' ELSE 'second' END AS mark FROM r JOIN t USING (task) WHERE rn <= 2""", ("metric",))
def _(s):
    m = s.metric.groupBy("arch", "task").agg(F.round(F.avg("value"), 9).alias("mean"))
    return _round(runs.best_marks(m), "mean")


@query("best_config", """SELECT task, arch, seed, round(value, 6) AS value FROM metric QUALIFY row_number() OVER (PARTITION BY task ORDER BY value DESC, arch, seed) = 1""", ("metric",))
def _(s):
    return _round(runs.best_config(s.metric, ("task",), ("arch", "seed")), "value")


@query("best_checkpoint", """SELECT arch, task, seed, round(value, 6) AS value FROM metric QUALIFY row_number() OVER (PARTITION BY arch, task ORDER BY value DESC, seed) = 1""", ("metric",))
def _(s):
    return _round(runs.best_checkpoint(s.metric, ("arch", "task"), "seed", "value"), "value")


_AFTER = "after AS (SELECT arch, task, seed, value + CASE WHEN arch % 3 = 0 THEN 0.001 ELSE 0.0 END AS value FROM metric WHERE seed < 4)"


def _after(s):
    return s.metric.filter("seed < 4").withColumn("value", F.col("value") + F.when(F.col("arch") % 3 == 0, 0.001).otherwise(0.0))


@query("compare_runs", f"""WITH {_AFTER} SELECT arch, task, seed, round(m.value, 6) AS before, round(a.value, 6) AS after, round(a.value - m.value, 6) + 0.0 AS delta
FROM metric m FULL OUTER JOIN after a USING (arch, task, seed)""", ("metric",))
def _(s):
    return _round(runs.compare_runs(s.metric, _after(s), ("arch", "task", "seed")), "before", "after", "delta")


@query("reproduction_gate", f"""WITH {_AFTER}, d AS (SELECT a.value - m.value AS delta FROM metric m FULL OUTER JOIN after a USING (arch, task, seed))
SELECT round(max(abs(delta)), 6) AS worst, count(*) FILTER (delta IS NULL) AS unmatched, max(abs(delta)) < 1e-6 AND count(*) FILTER (delta IS NULL) = 0 AS passed FROM d""", ("metric",))
def _(s):
    return _round(runs.reproduction_gate(runs.compare_runs(s.metric, _after(s), ("arch", "task", "seed"))), "worst")


@query("completeness_gate", """WITH n AS (SELECT task, arch, count(*) AS n FROM metric GROUP BY ALL)
SELECT task, count(*) AS cells, count(*) FILTER (n < 5) AS short_cells, min(n) >= 5 AS publishable FROM n GROUP BY task""", ("metric",))
def _(s):
    return runs.completeness_gate(s.metric)


@query("spread_ratio", """WITH c AS (SELECT task, arch, avg(value) AS m, stddev_samp(value) AS s FROM metric GROUP BY ALL)
SELECT task, round(max(m) - min(m), 6) AS band, round(median(s), 6) AS median_sd, round((max(m) - min(m)) / median(s), 6) AS ratio FROM c GROUP BY task""", ("metric",))
def _(s):
    return _round(runs.spread_ratio(s.metric), "band", "median_sd", "ratio")


@query("modality_gap", """SELECT task, round(avg(value) FILTER (arch % 2 = 0), 6) AS mean_a, round(avg(value) FILTER (arch % 2 = 1), 6) AS mean_b,
round(avg(value) FILTER (arch % 2 = 0) - avg(value) FILTER (arch % 2 = 1), 6) + 0.0 AS gap FROM metric GROUP BY task""", ("metric",))
def _(s):
    return _round(runs.modality_gap(s.metric.withColumn("g", F.col("arch") % 2), "g", 0, 1), "mean_a", "mean_b", "gap")


@query("recall_gap", f"""WITH {PRED5}, {CELLS5}, {report_sql('run_id', 'cells', 5)}
SELECT c AS cls, round(max(recall) FILTER (run_id = 1) - max(recall) FILTER (run_id = 2), 6) + 0.0 AS gap FROM cls GROUP BY c""", P5)
def _(s):
    pc = mt.per_class(mt.confusion_cells(pred5(s)), n_classes=5)
    return _round(runs.modality_gap(pc, "run_id", 1, 2, ("cls",), "recall").select("cls", "gap"), "gap")


@query("nested_result_macros", f"""WITH {PRED5}, {CELLS5}, {report_sql('run_id', 'cells', 5)} SELECT run_id, round(avg(precision), 6) AS macro_precision,
round(avg(recall), 6) AS macro_recall FROM cls GROUP BY run_id""", P5)
def _(s):
    pc = mt.per_class(mt.confusion_cells(pred5(s)), n_classes=5)
    nested = pc.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cls").cast("string"), F.struct("precision", "recall")))).alias("per_class"))
    out = runs.macro_of_map(runs.macro_of_map(nested, "precision"), "recall")
    return _round(out.select("run_id", "macro_precision", "macro_recall"), "macro_precision", "macro_recall")
