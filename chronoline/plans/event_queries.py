"""Queries over traces, annotations and recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.functions.hashing import mix_sql
from chronoline.functions.numbers import r6
from chronoline.operators import background, clips, events as ev, intervals as iv, ranking, timeline
from chronoline.operators.blocks import Blocks
from chronoline.plans.catalog import query, values
from chronoline.session import settle
from chronoline.sources import stores

# time constants of the stand-in traces (one row per session about every 11 hours)
WIN, GAP, MIN_DUR, MIN_IOU = 3600.0, 21600.0, 3600.0, 0.3
CURVE = ev.linspace(0.05, 0.99, 40)
# days become tens of days with them
BLOCKS = Blocks(width=864_000.0)


def _round(df, *cols):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def _bigint(df, *cols):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in cols else F.col(c) for c in df.columns])


def detections(s, thresholds=ev.THRESHOLDS):
    return settle(ev.extract_events(s.trace, thresholds, WIN, MIN_DUR, GAP, blocks=BLOCKS))


def det_sql(thresholds=ev.THRESHOLDS, trace="trace") -> str:
    return f"""
hits AS (SELECT session, modality, thr, t, p, t + {WIN} AS e FROM {trace}, {values(thresholds)} WHERE p >= thr),
opened AS (SELECT *, CASE WHEN t - max(e) OVER (PARTITION BY session, modality, thr ORDER BY t
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {GAP} THEN 0 ELSE 1 END AS o FROM hits),
numbered AS (SELECT *, sum(o) OVER (PARTITION BY session, modality, thr ORDER BY t) AS i FROM opened),
det AS (SELECT session, modality, thr, min(t) AS t_start, max(e) AS t_end, max(p) AS peak, count(*) AS n_hits
        FROM numbered GROUP BY session, modality, thr, i HAVING max(e) - min(t) >= {MIN_DUR})"""


MATCH_SQL = f"""
pairs AS (SELECT d.session, d.modality, d.thr, g.truth_id, d.t_start, d.t_end, g.t_start AS g_start, g.t_end AS g_end,
                 greatest(0.0, least(d.t_end, g.t_end) - greatest(d.t_start, g.t_start))
                 / (greatest(d.t_end, g.t_end) - least(d.t_start, g.t_start)) AS iou
          FROM det d JOIN truth g ON d.session = g.session),
packed AS (SELECT session, modality, thr,
                  list({{'g': truth_id, 'd': t_start, 'i': iou}} ORDER BY truth_id, -iou, t_start) AS todo
           FROM pairs WHERE iou > 0 AND iou >= {MIN_IOU} GROUP BY session, modality, thr),
folded AS (SELECT session, modality, thr, list_reduce(todo, lambda acc, x:
             CASE WHEN list_contains(acc.g, x.g) OR list_contains(acc.d, x.d) THEN acc
                  ELSE {{'g': list_append(acc.g, x.g), 'd': list_append(acc.d, x.d)}} END,
             {{'g': []::BIGINT[], 'd': []::DOUBLE[]}}) AS won FROM packed),
won AS (SELECT session, modality, thr, unnest(won.g) AS truth_id, unnest(won.d) AS t_start FROM folded),
matched AS (SELECT p.* FROM pairs p JOIN won USING (session, modality, thr, truth_id, t_start))"""

SCORE_SQL = f"""
grid AS (SELECT session, modality, thr FROM (SELECT DISTINCT session, modality FROM trace), {{vals}}),
nd AS (SELECT session, modality, thr, count(*) AS n_det FROM det GROUP BY ALL),
nm AS (SELECT session, modality, thr, count(*) AS tp, avg(abs(t_start - g_start)) AS onset_mae,
              avg(abs(t_end - g_end)) AS offset_mae, avg(iou) AS mean_iou FROM matched GROUP BY ALL),
ng AS (SELECT session, count(*) AS n_gt FROM truth GROUP BY session),
hrs AS (SELECT session, coalesce((max(t) FILTER (modality = 'video') - min(t) FILTER (modality = 'video')) / 3600.0,
                                 (max(t) - min(t)) / 3600.0) AS hours FROM trace GROUP BY session),
scored AS (SELECT session, modality, thr, coalesce(n_det, 0) AS n_det, coalesce(tp, 0) AS tp,
                  coalesce(n_det, 0) - coalesce(tp, 0) AS fp, coalesce(n_gt, 0) - coalesce(tp, 0) AS fn,
                  CASE WHEN coalesce(n_gt, 0) > 0 THEN coalesce(tp, 0) / n_gt::DOUBLE ELSE 0.0 END AS recall,
                  CASE WHEN coalesce(n_det, 0) > 0 THEN coalesce(tp, 0) / n_det::DOUBLE ELSE 0.0 END AS precision,
                  CASE WHEN hours > 0 THEN (coalesce(n_det, 0) - coalesce(tp, 0)) / hours ELSE 0.0 END AS fp_per_hour,
                  onset_mae, offset_mae, coalesce(mean_iou, 0.0) AS mean_iou
           FROM grid LEFT JOIN nd USING (session, modality, thr) LEFT JOIN nm USING (session, modality, thr)
                LEFT JOIN ng USING (session) LEFT JOIN hrs USING (session))"""


def r6s(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c.split('.')[-1]}" for c in cols)


@query("extract_events", f"WITH {det_sql()} SELECT session, modality, thr, {r6s('t_start', 't_end', 'peak')}, n_hits FROM det",
       ("trace",))
def _(s):
    return _round(ev.extract_events(s.trace, ev.THRESHOLDS, WIN, MIN_DUR, GAP, blocks=BLOCKS), "t_start", "t_end", "peak")


@query("match_events",
       f"WITH {det_sql()}, {MATCH_SQL} SELECT session, modality, thr, truth_id, {r6s('t_start', 't_end', 'g_start', 'g_end', 'iou')} FROM matched",
       ("trace", "truth"))
def _(s):
    return _round(ev.match_events(detections(s), s.truth, MIN_IOU, blocks=BLOCKS), "t_start", "t_end", "g_start", "g_end", "iou")


def event_scores(s):
    det = detections(s)
    m = ev.match_events(det, s.truth, MIN_IOU, blocks=BLOCKS)
    grid = ev.score_grid(s.trace, ev.THRESHOLDS)
    return ev.score_events(det, m, s.truth, grid, ev.trace_hours(s.trace))


_SCORES = ("recall", "precision", "fp_per_hour", "onset_mae", "offset_mae", "mean_iou")


@query("event_scores",
       f"WITH {det_sql()}, {MATCH_SQL}, {SCORE_SQL.format(vals=values(ev.THRESHOLDS))} "
       f"SELECT session, modality, thr, n_det, tp, fp, fn, {r6s(*_SCORES)} FROM scored", ("trace", "truth"))
def _(s):
    return _round(event_scores(s), *_SCORES)


@query("detected_events",
       f"WITH {det_sql()}, {MATCH_SQL} SELECT d.session, d.modality, d.thr, {r6s('d.t_start', 'd.t_end', 'd.peak')}, "
       "m.truth_id, round(coalesce(m.iou, 0.0), 6) AS iou FROM det d LEFT JOIN matched m "
       "ON d.session = m.session AND d.modality = m.modality AND d.thr = m.thr AND d.t_start = m.t_start",
       ("trace", "truth"))
def _(s):
    det = detections(s)
    out = ev.detected_events(det, ev.match_events(det, s.truth, MIN_IOU, blocks=BLOCKS)).drop("n_hits")
    return _round(out, "t_start", "t_end", "peak", "iou")


@query("false_alarms",
       f"WITH {det_sql()}, {MATCH_SQL} SELECT session, modality, thr, {r6s('t_start', 't_end')} FROM det d "
       "WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.session = d.session AND m.modality = d.modality "
       "AND m.thr = d.thr AND m.t_start = d.t_start)", ("trace", "truth"))
def _(s):
    det = detections(s)
    out = ev.false_alarms(det, ev.match_events(det, s.truth, MIN_IOU, blocks=BLOCKS)).select("session", "modality", "thr", "t_start", "t_end")
    return _round(out, "t_start", "t_end")


@query("missed_truths",
       f"WITH {det_sql()}, {MATCH_SQL}, {SCORE_SQL.format(vals=values(ev.THRESHOLDS))} "
       "SELECT g.session, g.modality, g.thr, t.truth_id FROM grid g JOIN truth t ON g.session = t.session "
       "WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.session = g.session AND m.modality = g.modality "
       "AND m.thr = g.thr AND m.truth_id = t.truth_id)", ("trace", "truth"))
def _(s):
    m = ev.match_events(detections(s), s.truth, MIN_IOU, blocks=BLOCKS)
    return ev.missed_truths(s.truth, m, ev.score_grid(s.trace, ev.THRESHOLDS)).select("session", "modality", "thr", "truth_id")


@query("operating_curve",
       f"WITH {det_sql(CURVE)}, {MATCH_SQL}, {SCORE_SQL.format(vals=values(CURVE))} "
       f"SELECT session, modality, {r6s('thr', 'fp_per_hour')}, round(recall, 6) + 0.0 AS sensitivity FROM scored",
       ("trace", "truth"))
def _(s):
    out = ev.operating_curve(s.trace, s.truth, ev.trace_hours(s.trace), CURVE, WIN, MIN_DUR, GAP, MIN_IOU, blocks=BLOCKS)
    return _round(out, "thr", "fp_per_hour", "sensitivity")


@query("scores_at_half",
       f"WITH {det_sql()}, {MATCH_SQL}, {SCORE_SQL.format(vals=values(ev.THRESHOLDS))} "
       f"SELECT session, modality, {r6s('fp_per_hour', 'recall')}, "
       "rank() OVER (PARTITION BY modality ORDER BY round(fp_per_hour, 6), session) AS place "
       "FROM scored WHERE abs(thr - 0.5) < 1e-9", ("trace", "truth"))
def _(s):
    out = event_scores(s).filter(F.abs(F.col("thr") - 0.5) < 1e-9)
    flat = settle(_round(out.select("session", "modality", "fp_per_hour", "recall"), "fp_per_hour", "recall"))
    return timeline.place_by(flat, "fp_per_hour", ("modality",), ("session",))


@query("trace_hours",
       "SELECT session, round(coalesce((max(t) FILTER (modality = 'video') - min(t) FILTER (modality = 'video')) / 3600.0, "
       "(max(t) - min(t)) / 3600.0), 6) AS hours FROM trace GROUP BY session", ("trace",))
def _(s):
    return _round(ev.trace_hours(s.trace), "hours")


@query("trace_average_precision", f"""
WITH marked AS (SELECT t.session, t.modality, t.p, CASE WHEN EXISTS (SELECT 1 FROM truth g WHERE g.session = t.session
        AND t.t + {WIN / 2} BETWEEN g.t_start AND g.t_end) THEN 1 ELSE 0 END AS y FROM trace t),
c AS (SELECT session, modality, p, sum(y) AS pos, sum(1 - y) AS neg FROM marked GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c
      WINDOW w AS (PARTITION BY session, modality ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT session, modality, round(CASE WHEN sum(pos) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END, 6) AS average_precision
FROM r GROUP BY session, modality""", ("trace", "truth"))
def _(s):
    return _round(ranking.average_precision(ev.label_trace(s.trace, s.truth, WIN, blocks=BLOCKS), ["session", "modality"], "p"),
                  "average_precision")


@query("trace_auroc", f"""
WITH marked AS (SELECT t.session, t.modality, t.p, CASE WHEN EXISTS (SELECT 1 FROM truth g WHERE g.session = t.session
        AND t.t + {WIN / 2} BETWEEN g.t_start AND g.t_end) THEN 1 ELSE 0 END AS y FROM trace t),
c AS (SELECT session, modality, p, sum(y) AS pos, sum(1 - y) AS neg FROM marked GROUP BY ALL),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY session, modality ORDER BY p
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT session, modality, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
        THEN sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) END, 6) AS auroc
FROM r GROUP BY session, modality""", ("trace", "truth"))
def _(s):
    return _round(ranking.auroc(ev.label_trace(s.trace, s.truth, WIN, blocks=BLOCKS), ["session", "modality"], "p"), "auroc")


@query("windows_inside_truth", f"""
SELECT session, modality, round(t, 6) AS t, EXISTS (SELECT 1 FROM truth g WHERE g.session = x.session
       AND x.t + {WIN / 2} BETWEEN g.t_start AND g.t_end) AS inside FROM trace x""", ("trace", "truth"))
def _(s):
    return _round(iv.inside_any(s.trace, s.truth, F.col("t") + F.lit(WIN / 2), blocks=BLOCKS).drop("p"), "t")


@query("trace_summary", """
WITH m AS (SELECT *, EXISTS (SELECT 1 FROM truth g WHERE g.session = x.session AND x.t BETWEEN g.t_start AND g.t_end) AS i
           FROM trace x)
SELECT session, modality, count(*) AS n, round((max(t) - min(t)) / 3600.0, 6) + 0.0 AS span_h, round(avg(p), 6) AS mean_p,
       round(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_above, count(*) FILTER (i) AS n_inside,
       round(avg(p) FILTER (i), 6) AS mean_p_inside FROM m GROUP BY session, modality""", ("trace", "truth"))
def _(s):
    return _round(ev.trace_summary(s.trace, s.truth, blocks=BLOCKS), "span_h", "mean_p", "share_above", "mean_p_inside")


_ASOF = """
WITH v AS (SELECT session, t, p FROM trace WHERE modality = 'video'), e AS (SELECT session, t, p FROM trace WHERE modality = 'eeg'),
j AS (SELECT v.session, v.t, v.p, coalesce((SELECT arg_min(e.p, e.t) FROM e WHERE e.session = v.session AND e.t >= v.t),
             (SELECT arg_max(e.p, e.t) FROM e WHERE e.session = v.session)) AS q FROM v)
"""


def _sides(s):
    side = lambda m: s.trace.filter(F.col("modality") == m).select("session", "t", "p")
    return side("video"), side("eeg")


@query("asof_join", _ASOF + "SELECT session, round(t, 6) AS t, round(p, 6) AS p, round(q, 6) AS p_right FROM j", ("trace",))
def _(s):
    return _round(ev.asof_join(*_sides(s), blocks=BLOCKS), "t", "p", "p_right")


@query("fuse_mean", _ASOF + "SELECT session, round(t, 6) AS t, round(0.5 * p + 0.5 * q, 6) AS p FROM j WHERE q IS NOT NULL", ("trace",))
def _(s):
    return _round(ev.fuse(*_sides(s), "mean", 0.5, blocks=BLOCKS), "t", "p")


@query("fuse_or", _ASOF + "SELECT session, round(t, 6) AS t, round(greatest(p, q), 6) AS p FROM j WHERE q IS NOT NULL", ("trace",))
def _(s):
    return _round(ev.fuse(*_sides(s), "or", blocks=BLOCKS), "t", "p")


@query("fuse_and", _ASOF + "SELECT session, round(t, 6) AS t, round(least(p, q), 6) AS p FROM j WHERE q IS NOT NULL", ("trace",))
def _(s):
    return _round(ev.fuse(*_sides(s), "and", blocks=BLOCKS), "t", "p")


@query("fused_event_scores",
       _ASOF + ", fused AS (SELECT session, 'fusion:mean' AS modality, t, 0.5 * p + 0.5 * q AS p FROM j WHERE q IS NOT NULL), "
       + det_sql(trace="fused") + ", " + MATCH_SQL + ", " + SCORE_SQL.format(vals=values(ev.THRESHOLDS)).replace(
           "SELECT DISTINCT session, modality FROM trace", "SELECT DISTINCT session, modality FROM fused")
       + f" SELECT session, modality, thr, n_det, tp, fp, fn, {r6s(*_SCORES)} FROM scored", ("trace", "truth"))
def _(s):
    fused = settle(ev.fuse(*_sides(s), "mean", 0.5, blocks=BLOCKS).select("session", F.lit("fusion:mean").alias("modality"), "t", "p"))
    det = settle(ev.extract_events(fused, ev.THRESHOLDS, WIN, MIN_DUR, GAP, blocks=BLOCKS))
    m = ev.match_events(det, s.truth, MIN_IOU, blocks=BLOCKS)
    out = ev.score_events(det, m, s.truth, ev.score_grid(fused, ev.THRESHOLDS), ev.trace_hours(s.trace))
    return _round(out, *_SCORES)


# ---- recordings and clips -------------------------------------------------

@query("recording_intervals", """
SELECT session, path, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM recording_iv""", ("recording_iv",))
def _(s):
    return _round(iv.recording_intervals(s.recording, blocks=BLOCKS).select("session", "path", "t_start", "t_end"), "t_start", "t_end")


_COVER = """
SELECT idx, path, round(rec_start, 6) AS rec_start FROM (
  SELECT a.idx, r.path, r.t_start AS rec_start, row_number() OVER (PARTITION BY a.idx ORDER BY r.t_start, r.path) AS rn
  FROM annotation a LEFT JOIN recording_iv r ON r.session = a.session AND r.t_start <= a.t_start AND a.t_start < r.t_end)
WHERE rn = 1"""


@query("cover_join", _COVER, ("annotation", "recording_iv"))
def _(s):
    return _round(iv.cover_join(s.annotation, s.recording_iv, blocks=BLOCKS).select("idx", "path", "rec_start"), "rec_start")


@query("cover_or_first", """
SELECT idx, path FROM (SELECT p.idx, r.path, row_number() OVER (PARTITION BY p.idx ORDER BY (r.t_start <= p.t_start AND p.t_start < r.t_end) DESC, r.t_start, r.path) AS rn
  FROM annotation p LEFT JOIN recording_iv r ON r.session = p.session) WHERE rn = 1""", ("annotation", "recording_iv"))
def _(s):
    return iv.cover_join(s.annotation, s.recording_iv, how="first", blocks=BLOCKS).select("idx", "path")


@query("window_coverage", """
SELECT session, modality, round(t, 6) AS t, path FROM (
  SELECT w.session, w.modality, w.t, r.path, row_number() OVER (PARTITION BY w.session, w.modality, w.t ORDER BY r.t_start, r.path) AS rn
  FROM trace w LEFT JOIN recording_iv r ON r.session = w.session AND r.t_start <= w.t AND w.t < r.t_end) WHERE rn = 1""",
       ("trace", "recording_iv"))
def _(s):
    return _round(iv.cover_join(s.trace, s.recording_iv, on="t", blocks=BLOCKS).select("session", "modality", "t", "path"), "t")


@query("nearest_recording", """
SELECT idx, nearest_path, round(gap_s, 6) + 0.0 AS gap_s FROM (
  SELECT a.idx, r.path AS nearest_path, a.t_start - r.t_end AS gap_s,
         row_number() OVER (PARTITION BY a.idx ORDER BY abs(r.t_start - a.t_start), r.t_start, r.path) AS rn
  FROM annotation a JOIN recording_iv r ON r.session = a.session) WHERE rn = 1""", ("annotation", "recording_iv"))
def _(s):
    return _round(iv.nearest_recording(s.annotation, s.recording_iv, blocks=BLOCKS).select("idx", "nearest_path", "gap_s"), "gap_s")


BLOCKED_SQL = """
padded AS (SELECT session, t_start - 40.0 AS s, t_end + 40.0 AS e FROM annotation),
b1 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY session ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
       THEN 0 ELSE 1 END AS o FROM padded),
b2 AS (SELECT *, sum(o) OVER (PARTITION BY session ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM b1),
blocked AS (SELECT session, min(s) AS t_start, max(e) AS t_end FROM b2 GROUP BY session, i)"""


def blocked(s):
    return settle(iv.merge_intervals(s.annotation, pad_before=40.0, pad_after=40.0, blocks=BLOCKS))


@query("merge_intervals", f"WITH {BLOCKED_SQL} SELECT session, {r6s('t_start', 't_end')} FROM blocked", ("annotation",))
def _(s):
    return _round(blocked(s), "t_start", "t_end")


FREE_SQL = """
clipped AS (SELECT r.session, r.path, r.t_start AS rs, r.t_end AS re, greatest(b.t_start, r.t_start) AS s, least(b.t_end, r.t_end) AS e
            FROM recording_iv r JOIN blocked b ON b.session = r.session AND b.t_start < r.t_end AND b.t_end > r.t_start),
marks AS (SELECT * FROM clipped UNION ALL SELECT session, path, t_start, t_end, t_end, t_end FROM recording_iv),
cur AS (SELECT *, greatest(rs, coalesce(max(e) OVER (PARTITION BY session, path ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rs)) AS c FROM marks),
free AS (SELECT session, path, rs, re, c AS t_start, s AS t_end FROM cur WHERE c < s)"""


@query("free_intervals", f"WITH {BLOCKED_SQL}, {FREE_SQL} SELECT session, path, {r6s('t_start', 't_end')} FROM free WHERE t_end - t_start >= 60.0",
       ("annotation", "recording_iv"))
def _(s):
    out = iv.free_intervals(s.recording_iv, blocked(s), 60.0, blocks=BLOCKS).select("session", "path", "t_start", "t_end")
    return _round(out, "t_start", "t_end")


@query("sample_background", f"""
WITH {BLOCKED_SQL}, {FREE_SQL},
ann AS (SELECT *, t_end - t_start + 20.0 AS need FROM annotation),
cover AS (SELECT idx, path FROM (SELECT a.idx, r.path, row_number() OVER (PARTITION BY a.idx ORDER BY r.t_start, r.path) AS rn
          FROM annotation a JOIN recording_iv r ON r.session = a.session AND r.t_start <= a.t_start AND a.t_start < r.t_end) WHERE rn = 1),
fits AS (SELECT a.idx, f.path, f.rs, f.t_start, f.t_end - f.t_start - a.need AS w, coalesce(c.path = f.path, false) AS own
         FROM ann a JOIN free f ON f.session = a.session AND f.t_end - f.t_start > a.need LEFT JOIN cover c ON c.idx = a.idx),
rec AS (SELECT idx, path FROM (SELECT DISTINCT idx, path, rs, own FROM fits) QUALIFY row_number() OVER (PARTITION BY idx
        ORDER BY own DESC, rs, path) = 1),
mine AS (SELECT f.*, sum(w) OVER (PARTITION BY idx ORDER BY t_start ROWS UNBOUNDED PRECEDING) AS cum,
                sum(w) OVER (PARTITION BY idx) AS total FROM fits f JOIN rec USING (idx, path)),
drawn AS (SELECT * FROM mine WHERE {mix_sql('idx', 42)} / 2147483647.0 * total <= cum
          QUALIFY row_number() OVER (PARTITION BY idx ORDER BY t_start) = 1)
SELECT a.idx, d.path, round(d.t_start + {mix_sql('a.idx', 43)} / 2147483647.0 * d.w, 3) AS clip_start,
       round(d.t_start + {mix_sql('a.idx', 43)} / 2147483647.0 * d.w + a.need, 3) AS clip_end
FROM ann a LEFT JOIN drawn d ON d.idx = a.idx""", ("annotation", "recording_iv"))
def _(s):
    out = background.sample_background(s.annotation, s.recording_iv, blocked(s), pre=10.0, post=10.0, seed=42, blocks=BLOCKS)
    return out.select("idx", "path", F.round("clip_start", 3).alias("clip_start"), F.round("clip_end", 3).alias("clip_end"))


@query("clip_bounds", """
WITH c AS (SELECT idx, path, rec_start, rec_end FROM (
  SELECT a.idx, r.path, r.t_start AS rec_start, r.t_end AS rec_end, row_number() OVER (PARTITION BY a.idx ORDER BY r.t_start, r.path) AS rn
  FROM annotation a LEFT JOIN recording_iv r ON r.session = a.session AND r.t_start <= a.t_start AND a.t_start < r.t_end) WHERE rn = 1)
SELECT a.idx, 'seizure_' || lpad(a.idx::VARCHAR, greatest(2, length(a.idx::VARCHAR))::INTEGER, '0') || '_' || regexp_replace(a.label, '\\W', '_', 'g')
       || '_' || strftime(make_timestamp(floor(a.t_start)::BIGINT * 1000000), '%Y%m%d_%H%M%S') AS clip_name,
       round(a.t_start - 10.0, 6) AS clip_start, round(a.t_end + 10.0, 6) AS clip_end,
       CASE WHEN c.path IS NOT NULL THEN round(greatest(0.0, a.t_start - c.rec_start - 10.0), 6) END AS seek_s,
       CASE WHEN c.path IS NULL THEN round(a.t_end - a.t_start + 20.0, 6) ELSE round(least(a.t_end - a.t_start + 20.0, c.rec_end - c.rec_start - greatest(0.0, a.t_start - c.rec_start - 10.0)), 6) END AS clip_len,
       CASE WHEN c.path IS NULL THEN '—' ELSE
         lpad((greatest(0, trunc(a.t_start - c.rec_start))::BIGINT // 3600)::VARCHAR, 2, '0') || ':' ||
         lpad((greatest(0, trunc(a.t_start - c.rec_start))::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' ||
         lpad((greatest(0, trunc(a.t_start - c.rec_start))::BIGINT % 60)::VARCHAR, 2, '0') END AS video_seek
FROM annotation a JOIN c ON c.idx = a.idx""", ("annotation", "recording_iv"))
def _(s):
    out = clips.clip_bounds(iv.cover_join(s.annotation, s.recording_iv, blocks=BLOCKS), pre=10.0, post=10.0)
    return _round(out.select("idx", "clip_name", "clip_start", "clip_end", "seek_s", "clip_len", "video_seek"),
                  "clip_start", "clip_end", "seek_s", "clip_len")


@query("crop_windows", """
WITH c AS (SELECT * FROM (
  SELECT a.idx, a.t_start, a.t_end, r.t_start AS rs, r.t_end AS re, row_number() OVER (PARTITION BY a.idx ORDER BY r.t_start, r.path) AS rn
  FROM annotation a JOIN recording_iv r ON r.session = a.session AND r.t_start <= a.t_start AND a.t_start < r.t_end) WHERE rn = 1),
k AS (SELECT idx, greatest(0.0, t_start - 10.0 - rs) AS t0, least(re - rs, t_end + 10.0 - rs) AS t1 FROM c)
SELECT idx, round(t0, 6) AS crop_start, round(t1, 6) AS crop_end,
       CASE WHEN t1 <= t0 THEN 'empty' WHEN t1 - t0 < 1.0 THEN 'too_short' ELSE 'ok' END AS crop_status FROM k""",
       ("annotation", "recording_iv"))
def _(s):
    cov = iv.cover_join(s.annotation, s.recording_iv, how="inner", blocks=BLOCKS)
    return _round(clips.crop_windows(cov, 10.0, 10.0).select("idx", "crop_start", "crop_end", "crop_status"), "crop_start", "crop_end")


@query("clip_outcomes", """
WITH v AS (SELECT a.idx, a.session, max(CASE WHEN r.path IS NOT NULL THEN 1 ELSE 0 END) AS video
           FROM annotation a LEFT JOIN recording_iv r ON r.session = a.session AND r.t_start <= a.t_start AND a.t_start < r.t_end
           GROUP BY a.idx, a.session),
e AS (SELECT a.idx, max(CASE WHEN r.path IS NOT NULL THEN 1 ELSE 0 END) AS eeg
      FROM annotation a LEFT JOIN (SELECT * FROM recording_iv WHERE day % 2 = 0) r ON r.session = a.session AND r.t_start <= a.t_start
      AND a.t_start < r.t_end GROUP BY a.idx)
SELECT session, count(*) AS n, count(*) FILTER (video = 1 AND eeg = 1) AS both, count(*) FILTER (video = 1 AND eeg = 0) AS video_only,
       count(*) FILTER (video = 0 AND eeg = 1) AS eeg_only, count(*) FILTER (video = 0 AND eeg = 0) AS skipped
FROM v JOIN e USING (idx) GROUP BY ROLLUP(session)""", ("annotation", "recording_iv"))
def _(s):
    eeg = s.recording_iv.filter(F.col("day") % 2 == 0)
    return clips.clip_outcomes(clips.coverage(s.annotation, s.recording_iv, eeg, blocks=BLOCKS))


@query("event_log", """
WITH c AS (SELECT * FROM (
  SELECT a.*, r.t_start AS rs, row_number() OVER (PARTITION BY a.idx ORDER BY r.t_start, r.path) AS rn
  FROM annotation a LEFT JOIN recording_iv r ON r.session = a.session AND r.t_start <= a.t_start AND a.t_start < r.t_end) WHERE rn = 1)
SELECT session, idx, row_number() OVER (PARTITION BY session ORDER BY t_start, idx) AS clip_n, label,
       CASE WHEN rs IS NULL THEN 'NO_COVERAGE' ELSE 'OK' END AS video_status, round(t_end - t_start + 20.0, 1) AS clip_len
FROM c""", ("annotation", "recording_iv"))
def _(s):
    cov = iv.cover_join(s.annotation, s.recording_iv, blocks=BLOCKS)
    return clips.event_log(cov, 10.0, 10.0, blocks=BLOCKS).select("session", "idx", "clip_n", "label", "video_status", F.round("clip_len", 1).alias("clip_len"))


@query("filter_labels", """
SELECT session, count(*) AS total, count(*) FILTER (NOT lower(label) LIKE '%spike%' AND (lower(label) LIKE '%stage 3%' OR lower(label) LIKE '%stage 4%'))
       AS kept, count(*) - count(*) FILTER (NOT lower(label) LIKE '%spike%' AND (lower(label) LIKE '%stage 3%' OR lower(label) LIKE '%stage 4%'))
       AS excluded FROM annotation GROUP BY session""", ("annotation",))
def _(s):
    return clips.label_counts(s.annotation, keep=("Stage 3", "Stage 4"))


@query("moving_average", """
WITH w AS (SELECT *, count(*) OVER (PARTITION BY session, modality) AS n FROM trace)
SELECT session, modality, round(t, 6) AS t, round(CASE WHEN n > 7 THEN sum(p) OVER (PARTITION BY session, modality ORDER BY t
       ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0 ELSE p END, 6) AS smooth FROM w""", ("trace",))
def _(s):
    return _round(timeline.moving_average(s.trace, 7, blocks=BLOCKS).select("session", "modality", "t", "smooth"), "t", "smooth")


@query("merge_traces", """
WITH f AS (SELECT *, CASE WHEN session % 3 = 0 AND modality = 'eeg' THEN 2 ELSE 1 END AS file_ord FROM trace),
dup AS (SELECT * FROM f UNION ALL SELECT session, modality, t, p / 2, file_ord + 1 FROM f)
SELECT session, modality, round(t, 6) AS t, round(p, 6) AS p FROM dup QUALIFY file_ord = min(file_ord) OVER (PARTITION BY session, modality)""",
       ("trace",))
def _(s):
    f = s.trace.withColumn("file_ord", F.when((F.col("session") % 3 == 0) & (F.col("modality") == "eeg"), 2).otherwise(1))
    dup = f.unionByName(f.withColumn("p", F.col("p") / 2).withColumn("file_ord", F.col("file_ord") + 1))
    return _round(timeline.merge_traces(dup).select("session", "modality", "t", "p"), "t", "p")


@query("clock_delta", """
WITH v AS (SELECT session, min(t_start) AS v0 FROM recording_iv WHERE day % 2 = 1 GROUP BY session),
e AS (SELECT session, min(t_start) AS e0 FROM recording_iv WHERE day % 2 = 0 GROUP BY session)
SELECT session, round(v0 - e0, 6) AS delta_s, coalesce(v0 - e0 BETWEEN 10.0 AND 25.0, false) AS in_band
FROM v FULL OUTER JOIN e USING (session)""", ("recording_iv",))
def _(s):
    r = s.recording_iv
    return _round(timeline.clock_delta(r.filter(F.col("day") % 2 == 1), r.filter(F.col("day") % 2 == 0)), "delta_s")


@query("session_qc", """
WITH r AS (SELECT session, count(*) AS n_recordings, count(*) FILTER (dur_s IS NULL) AS n_without_length FROM recording GROUP BY session),
a AS (SELECT session, count(*) AS annotations_total, count(*) FILTER (NOT lower(label) LIKE '%spike%') AS annotations_kept FROM annotation GROUP BY session)
SELECT session, n_recordings, n_without_length, coalesce(annotations_total, 0) AS annotations_total,
       coalesce(annotations_kept, 0) AS annotations_kept, coalesce(annotations_total - annotations_kept, 0) AS labels_excluded
FROM r LEFT JOIN a USING (session)""", ("recording", "annotation"))
def _(s):
    return timeline.session_qc(s.recording, s.annotation)


# a signal file for every second day, started before the first video of the day by 3 to 27 seconds
_SIGNALS = """sig AS (SELECT session, replace(path, '.mp4', '.edf') AS path, t_start - (3 + (day + session) % 25) AS t_start, t_start + 3600.0 * (1 + day % 50) AS t_end FROM recording WHERE day % 2 = 0),
vid AS (SELECT session, t_start, day % 4 <> 3 AS has_sidecar FROM recording)"""


@query("session_inputs", f"""
WITH {_SIGNALS},
r AS (SELECT session, count(*) FILTER (has_sidecar) AS n_recordings, count(*) FILTER (NOT has_sidecar) AS n_missing_sidecar, min(t_start) FILTER (has_sidecar) AS v FROM vid GROUP BY session),
a AS (SELECT session, min(t_start) AS a FROM annotation WHERE NOT lower(label) LIKE '%spike%' GROUP BY session),
e AS (SELECT session, count(*) AS n_signals, min({{'path': path, 't': t_start}}) AS f, min({{'path': path, 't': t_start}}) FILTER (t_start <= a AND a < t_end) AS own
      FROM sig LEFT JOIN a USING (session) GROUP BY session)
SELECT session, n_recordings, n_missing_sidecar, coalesce(n_signals, 0) AS n_signals, coalesce(own, f).path AS signal_selected, own IS NOT NULL AS covers,
       round(v - coalesce(own, f).t, 6) AS clock_delta_s, v - coalesce(own, f).t BETWEEN 10 AND 25 AS clocks_agree
FROM r LEFT JOIN e USING (session)""", ("recording", "annotation"))
def _(s):
    r = s.recording
    signals = r.filter("day % 2 = 0").select(
        "session", F.replace("path", F.lit(".mp4"), F.lit(".edf")).alias("path"), (F.col("t_start") - (3 + (F.col("day") + F.col("session")) % 25)).alias("t_start"),
        (F.col("t_start") + 3600.0 * (1 + F.col("day") % 50)).alias("t_end"))
    videos = r.select("session", "t_start", (F.col("day") % 4 != 3).alias("has_sidecar"))
    return _round(timeline.session_inputs(videos, s.annotation, signals), "clock_delta_s")


@query("recorded_hours", """
SELECT session, count(*) AS n_files, count(*) FILTER (dur_s IS NULL) AS n_rejected, round(coalesce(sum(dur_s), 0.0) / 3600.0, 6) AS hours
FROM recording GROUP BY session""", ("recording",))
def _(s):
    return _round(timeline.recorded_hours(s.recording), "hours")


@query("recording_length", """
WITH f AS (SELECT session, path, CASE WHEN file_no % 7 = 3 THEN NULL ELSE t_start END AS t_start, (file_no % 5) * 300 AS frames, CASE WHEN file_no % 3 = 0 THEN 0.0 ELSE 25.0 END AS fps
  FROM (SELECT *, length(path) + round(t_start)::BIGINT AS file_no FROM recording))
SELECT session, path, CASE WHEN t_start IS NULL THEN 'no_start' WHEN frames <= 0 THEN 'unreadable' ELSE 'ok' END AS reason,
  round(CASE WHEN t_start IS NOT NULL AND frames > 0 THEN frames / (CASE WHEN fps > 0 THEN fps ELSE 15.0 END)::DOUBLE END, 6) AS dur_s FROM f""", ("recording",))
def _(s):
    no = F.length("path") + F.round("t_start").cast("bigint")
    files = s.recording.select(
        "session", "path", F.when(no % 7 != 3, F.col("t_start")).alias("t_start"), ((no % 5) * 300).alias("frames"), F.when(no % 3 == 0, 0.0).otherwise(25.0).alias("fps"),
    )
    return _round(timeline.recording_length(files).select("session", "path", "reason", "dur_s"), "dur_s")


@query("session_documents",
       f"WITH {det_sql()}, {MATCH_SQL}, {SCORE_SQL.format(vals=values(ev.THRESHOLDS))}, q AS (SELECT session, count(*) AS n_recordings FROM recording GROUP BY session) "
       "SELECT q.session, n_recordings, count(s.thr) AS sweep_rows, coalesce(sum(s.tp), 0)::BIGINT AS tp FROM q LEFT JOIN scored s ON s.session = q.session GROUP BY q.session, n_recordings",
       ("trace", "truth", "recording"))
def _(s):
    docs = stores.session_documents(event_scores(s), timeline.session_qc(s.recording, s.annotation))
    return docs.select("session", "qc.n_recordings", F.coalesce(F.size("sweep"), F.lit(0)).cast("bigint").alias("sweep_rows"),
                       F.aggregate("sweep", F.lit(0).cast("bigint"), lambda a, x: a + x["tp"]).alias("tp"))
