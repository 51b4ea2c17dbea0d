"""Stand-in views over the given tables: the typed inputs the operators expect.

One SQL text serves Spark (through ``spark.sql`` with DataFrame arguments) and the
comparison engine (as common table expressions), so both sides read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from chronoline.operators.blocks import Blocks
from chronoline.operators.intervals import recording_intervals
from chronoline.session import prepare, settle

# name -> (inputs, SQL). {EPOCH} and EACH(a, b), one row per integer a..b, are rewritten
# per engine.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "trace": (("events",), """
SELECT user_id AS session, CASE WHEN event_id % 2 = 0 THEN 'video' ELSE 'eeg' END AS modality,
       {EPOCH} AS t, value / (value + 50.0) AS p
FROM {events}"""),
    "annotation": (("events",), """
SELECT event_id AS idx, user_id AS session,
       CASE WHEN event_id % 7 = 0 THEN 'Spikes' ELSE concat('Stage ', CAST(1 + event_id % 5 AS STRING)) END AS label,
       {EPOCH} AS t_start, {EPOCH} + 60.0 * value AS t_end
FROM {events} WHERE event_type = 'error'"""),
    "recording": (("trace",), """
SELECT session, day, concat('RN', CAST(100 + session AS STRING), '.', CAST(day AS STRING), '.mp4') AS path,
       t_start, CASE WHEN day % 5 = 0 THEN NULL ELSE dur_s END AS dur_s
FROM (SELECT session, CAST(floor(t / 86400) AS BIGINT) AS day, min(t) AS t_start, 3600.0 + max(t) - min(t) AS dur_s
      FROM {trace} GROUP BY session, CAST(floor(t / 86400) AS BIGINT)) r"""),
    "window_v": (("embeddings",), """
SELECT CAST(floor(vec_id / 5) AS BIGINT) AS clip_id, vec_id % 5 AS w_idx, embedding AS samples,
       label % 5 AS wlab FROM {embeddings}"""),
    "clip": (("window_v",), """
SELECT clip_id, max(CASE WHEN w_idx = 0 THEN wlab END) AS y, clip_id % 20 AS session, (clip_id % 20) % 6 AS subject
FROM {window_v} GROUP BY clip_id"""),
    "signal": (("embeddings",), """
SELECT label AS session, vec_id AS block_id, embedding AS samples FROM {embeddings}"""),
    "window_score": (("window_v",), """
SELECT run_id, clip_id, w_idx, k,
       1 + (clip_id * 31 + w_idx * 17 + run_id * 13 + k * 29) % 37 + CASE WHEN k = wlab THEN 25 ELSE 0 END AS w
FROM (SELECT *, EACH(0, 4) AS k
      FROM (SELECT clip_id, w_idx, wlab, EACH(1, 5) AS run_id FROM {window_v}) r) c"""),
    "prediction": (("labels",), """
SELECT run_id, doc_id AS clip, doc_id % 6 AS subject, quality AS y,
       CASE WHEN (doc_id * 7919 + run_id * 104729) % 100 < 80 THEN quality ELSE 1 - quality END AS pred,
       (CASE WHEN quality = 1 THEN 40 ELSE 0 END + (doc_id * 613 + run_id * 211) % 60) / CAST(100 AS DOUBLE) AS score
FROM (SELECT *, EACH(1, 5) AS run_id FROM {labels}) l"""),
    # one run grid per supplier: it grows with the tables, has gaps and collapsed runs
    "metric": (("supplier",), """
SELECT arch, task, seed, 'macro_f1' AS name,
       CASE WHEN arch % 7 = 2 AND seed = 3 THEN 20
            ELSE 90 - 15 * task + (arch * 17 + task * 5 + seed * 3) % 11 END / CAST(100 AS DOUBLE) AS value
FROM (SELECT arch, task, EACH(0, 4) AS seed
      FROM (SELECT s_suppkey AS arch, EACH(0, 2) AS task FROM {supplier}) a) g
WHERE NOT (arch % 7 = 5 AND seed = 4)"""),
    "kv": (("orders",), """
SELECT o_orderkey AS clip_id,
       concat('Label : Stage ', CAST(o_orderkey % 6 AS STRING), chr(10), 'Duration (s) : ', CAST(o_custkey % 90 AS STRING),
              CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(chr(10), 'Pre-buffer (s) : 10') END) AS body
FROM {orders}"""),
    "manifest": (("part",), """
SELECT p_partkey AS file_id,
       concat('Data_RN', CAST(197 + p_partkey % 20 AS STRING), '_cropped/s', CAST(p_partkey % 40 AS STRING), '/',
              CASE WHEN p_partkey % 2 = 0 THEN concat('seizure_', CAST(p_partkey AS STRING), '_Stage_', CAST(1 + p_size % 5 AS STRING))
                   ELSE concat('clip_', CAST(p_partkey AS STRING), '_vs_seizure_', CAST(p_partkey AS STRING)) END,
              CASE WHEN p_partkey % 9 = 0 THEN '/info.txt' ELSE '/video.mp4' END) AS path,
       p_size * 1000 AS length
FROM {part}"""),
    "filename": (("part",), """
SELECT p_partkey AS file_id,
       CASE WHEN p_partkey % 5 = 0
            THEN concat('RN', CAST(100 + p_partkey % 50 AS STRING), '-22 (', CAST(1 + p_partkey % 12 AS STRING), '-',
                        CAST(1 + p_partkey % 28 AS STRING), ' to 12-31).edf')
            ELSE concat('RN208-RN223.2024', lpad(CAST(CASE WHEN p_partkey % 9 = 0 THEN 13 ELSE 1 + p_partkey % 12 END AS STRING), 2, '0'),
                        lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0'), lpad(CAST(p_partkey % 24 AS STRING), 2, '0'),
                        lpad(CAST(p_partkey % 60 AS STRING), 2, '0'), CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '30' END, '.mp4') END AS name
FROM {part}"""),
    "record": (("documents",), """
SELECT doc_id, text AS title, source AS source_api, lang AS topic, n_chars AS cited_by_count, text AS abstract
FROM {documents}"""),
    # truth (D14): annotations left after the label filter
    "truth": (("annotation",), """
SELECT session, idx AS truth_id, t_start, t_end FROM {annotation} WHERE NOT lower(label) LIKE '%spike%'"""),
    # recordings with an end: own length, else next start, else four hours
    "recording_iv": (("recording",), """
SELECT session, day, path, t_start,
       coalesce(t_start + dur_s, lead(t_start) OVER (PARTITION BY session ORDER BY t_start, path), t_start + 14400.0) AS t_end
FROM {recording}"""),
    # class shares of a window, one row per class
    "posterior": (("window_score",), """
SELECT run_id, clip_id, w_idx, k, w / CAST(sum(w) OVER (PARTITION BY run_id, clip_id, w_idx) AS DOUBLE) AS p
FROM {window_score}"""),
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _text(sql: str, engine: str, names: dict[str, str]) -> str:
    if engine == "spark":
        epoch, each = "unix_micros(CAST(ts AS timestamp)) / 1e6", r"explode(sequence(\1, \2))"
    else:
        epoch, each = "epoch_us(ts) / 1e6", r"CAST(unnest(generate_series(\1, \2)) AS INT)"
    sql = re.sub(r"EACH\((\d+), (\d+)\)", each, sql)
    return sql.replace("{EPOCH}", epoch).format(**names)


class StandIns:
    """Lazy access to tables and stand-in views as DataFrames: ``s.trace``, ``s.orders``..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name == "recording_iv":
                # the operator, not the view's whole-session window
                ends = recording_intervals(self.recording, blocks=Blocks(width=864_000.0)).select("session", "day", "path", "t_start", "t_end")
                self._made[name] = settle(ends)
            elif name in VIEWS:
                inputs, sql = VIEWS[name]
                args = {i: getattr(self, i) for i in inputs}
                self._made[name] = self.spark.sql(_text(sql, "spark", {i: "{" + i + "}" for i in inputs}), **args)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]


def with_views(body: str, *views: str) -> str:
    """Comparison SQL: the views it needs as common table expressions, then the body.

    ``body`` is a SELECT, or a list of further common table expressions that ends in
    one, introduced by ``WITH``.
    """
    need: list[str] = []

    def add(v: str) -> None:
        if v in VIEWS and v not in need:
            for i in VIEWS[v][0]:
                add(i)
            need.append(v)

    for v in views:
        add(v)
    parts = [f"{v} AS ({_text(VIEWS[v][1], 'duckdb', {i: i for i in VIEWS[v][0]})})" for v in need]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[len("WITH "):]
    return "WITH " + ",\n".join(parts) + "\n" + body
