"""Queries over manifests, sidecar text, records and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoline.functions import paths as pt, text as tx, timefmt as tf
from chronoline.functions.numbers import r6
from chronoline.operators import cohort as co, records as rc
from chronoline.plans.catalog import query, values
from chronoline.plans.event_queries import GAP, MIN_DUR, WIN, _round, det_sql, r6s
from chronoline.operators import events as ev
from chronoline.session import scratch_path
from chronoline.sources import sheets, sidecars, stores
from chronoline.streaming import events as st

_DISC = """
vid AS (SELECT regexp_replace(path, '/video.mp4$', '') AS clip FROM manifest WHERE path LIKE '%/video.mp4'),
cls AS (SELECT clip, split_part(clip, '/', -1) AS nm, regexp_extract(clip, 'RN[0-9]{3}') AS subject, split_part(clip, '/', -2) AS ses FROM vid),
disc AS (SELECT clip, subject, subject || '/' || ses AS session_key, CASE WHEN nm LIKE 'seizure_%' THEN CASE regexp_extract(nm, 'Stage_[0-9]+')
         WHEN 'Stage_2' THEN 1 WHEN 'Stage_3' THEN 2 WHEN 'Stage_4' THEN 3 WHEN 'Stage_5' THEN 4 END ELSE 0 END AS y FROM cls),
items AS (SELECT * FROM disc WHERE y IS NOT NULL)"""


@query("discover_clips", f"WITH {_DISC} SELECT clip, y, session_key, subject FROM items", ("manifest",))
def _(s):
    return co.discover_clips(s.manifest)


@query("discovery_audit", """WITH d AS (SELECT regexp_replace(path, '/(video.mp4|info.txt)$', '') AS clip, path LIKE '%/video.mp4' AS v FROM manifest),
r AS (SELECT CASE WHEN NOT v THEN 'no_video' WHEN clip LIKE '%/seizure_%' AND clip LIKE '%Stage_1' THEN 'unknown_stage' ELSE 'ok' END AS reason FROM d)
SELECT reason, count(*) AS n FROM r GROUP BY reason""", ("manifest",))
def _(s):
    return co.discovery_audit(s.manifest)


_SES = "ses AS (SELECT regexp_extract(path, 'RN[0-9]{3}') || '/' || split_part(path, '/', 2) AS session_key, path FROM manifest)"


@query("list_sessions", f"WITH {_SES} SELECT session_key, count(*) AS files FROM ses GROUP BY session_key", ("manifest",))
def _(s):
    return co.list_sessions(s.manifest)


@query("list_sessions_with_sheet", f"WITH {_SES} SELECT session_key, count(*) AS files FROM ses GROUP BY session_key HAVING count(*) FILTER (path LIKE '%/info.txt') > 0", ("manifest",))
def _(s):
    return co.list_sessions(s.manifest, with_sheet=True, sheet=r"^info\.txt$")  # the stand-in files have no sheets


@query("distinct_files", "SELECT path, max(length) AS length FROM (SELECT * FROM manifest UNION ALL SELECT * FROM manifest) GROUP BY path", ("manifest",))
def _(s):
    return s.manifest.unionByName(s.manifest).dropDuplicates(["path"]).select("path", "length")


@query("subject_from_path", "SELECT file_id, nullif(regexp_extract(path, 'RN[0-9]{3}'), '') AS subject, list_extract(string_split(path, '_'), -4) AS token FROM manifest", ("manifest",))
def _(s):
    return s.manifest.select("file_id", pt.subject_of(F.col("path")).alias("subject"), pt.subject_from_tokens(F.col("path")).alias("token"))


@query("subject_union", "SELECT DISTINCT regexp_extract(path, 'RN[0-9]{3}') AS subject FROM manifest UNION SELECT DISTINCT 'RN' || (100 + user_id)::VARCHAR FROM events", ("manifest",))
def _(s):
    a = s.manifest.select(pt.subject_of(F.col("path")).alias("subject"))
    return a.union(s.events.select(F.concat(F.lit("RN"), (F.col("user_id") + 100).cast("string")))).distinct()


@query("cohort_table", f"""WITH {_DISC} SELECT subject, count(DISTINCT session_key) AS sessions, count(*) AS clips,
{", ".join(f"count(*) FILTER (y = {c}) AS class_{c}" for c in range(5))} FROM items GROUP BY ROLLUP(subject)""", ("manifest",))
def _(s):
    return co.cohort_table(co.discover_clips(s.manifest))


@query("missing_keys", "SELECT clip FROM (SELECT DISTINCT path AS clip FROM manifest) ANTI JOIN (SELECT path AS clip FROM manifest WHERE length > 20000) USING (clip)", ("manifest",))
def _(s):
    m = s.manifest.withColumnRenamed("path", "clip")
    return co.missing_keys(m, m.filter("length > 20000"), "clip")


_COPY = "c AS (SELECT path, CASE WHEN file_id % 10 = 3 THEN length - 1 ELSE length END AS length FROM manifest WHERE length < 48000 UNION ALL SELECT 'extra/' || file_id, 5 FROM manifest WHERE file_id % 100 = 1)"


@query("reconcile_copy", f"""WITH {_COPY}, j AS (SELECT CASE WHEN c.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN m.length <> c.length THEN 'size_differs' ELSE 'same' END AS status,
m.length AS a, c.length AS b FROM manifest m FULL OUTER JOIN c ON m.path = c.path)
SELECT status, count(*) AS files, coalesce(sum(a), 0)::BIGINT AS source_bytes, coalesce(sum(b), 0)::BIGINT AS copy_bytes FROM j GROUP BY ROLLUP(status)""", ("manifest",))
def _(s):
    m = s.manifest
    copy = m.filter("length < 48000").select("path", F.when(F.col("file_id") % 10 == 3, F.col("length") - 1).otherwise(F.col("length")).alias("length"))
    extra = m.filter("file_id % 100 = 1").select(F.concat(F.lit("extra/"), F.col("file_id").cast("string")).alias("path"), F.lit(5).cast("bigint").alias("length"))
    out = co.reconcile(m.select("path", F.col("length").cast("bigint").alias("length")), copy.select("path", F.col("length").cast("bigint").alias("length")).unionByName(extra))
    return out


@query("recover_items", f"""WITH {_DISC}, n AS (SELECT file_id, y, row_number() OVER (ORDER BY file_id) - 1 AS idx FROM (SELECT m.file_id, i.y FROM manifest m JOIN items i ON m.path = i.clip || '/video.mp4')),
p AS (SELECT idx, CASE WHEN idx % 97 = 0 THEN 9 ELSE y END AS y FROM n)
SELECT p.idx, n.file_id, n.y = p.y AS agrees FROM p LEFT JOIN n USING (idx)""", ("manifest",))
def _(s):
    items = s.manifest.withColumn("clip", pt.clip_dir(F.col("path"))).join(co.discover_clips(s.manifest).select("clip", "y"), "clip").filter(F.col("path").endswith("video.mp4"))
    items = items.select("file_id", "y")
    from chronoline.operators.blocks import Blocks, row_numbers

    stored = row_numbers(items, [], "file_id", "_n", blocks=Blocks(width=10_000.0)).select(
        (F.col("_n") - 1).alias("idx"), F.when((F.col("_n") - 1) % 97 == 0, 9).otherwise(F.col("y")).alias("y"))
    return co.recover_items(items, stored, "file_id").select("idx", "file_id", "agrees")


@query("number_clips", f"WITH {_DISC} SELECT clip, row_number() OVER (ORDER BY clip) - 1 AS clip_id FROM items", ("manifest",))
def _(s):
    return stores.number_rows(co.discover_clips(s.manifest).select("clip"), ["clip"])


@query("first_files", "SELECT session_key, path FROM (SELECT regexp_extract(path, 'RN[0-9]{3}') || '/' || split_part(path, '/', 2) AS session_key, path FROM manifest) QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY path) <= 3", ("manifest",))
def _(s):
    m = s.manifest.select(pt.session_of(pt.clip_dir(F.col("path"))).alias("session_key"), "path")
    return stores.cap_per_group(m, ["session_key"], ["path"], 3)


@query("middle_file", "WITH m AS (SELECT regexp_extract(path, 'RN[0-9]{3}') AS subject, path FROM manifest) SELECT subject, path FROM m QUALIFY row_number() OVER (PARTITION BY subject ORDER BY path) = count(*) OVER (PARTITION BY subject) // 2 + 1", ("manifest",))
def _(s):
    return stores.middle_row(s.manifest.select(pt.subject_of(F.col("path")).alias("subject"), "path"), "subject", "path")


@query("hours_by_class", "WITH c AS (SELECT clip_id % 6 AS y, regexp_extract(body, 'Duration \\(s\\) : ([0-9]+)', 1)::DOUBLE AS d FROM kv) SELECT y, count(*) AS clips, round(sum(d) / 3600.0, 6) AS hours, round(avg(d), 6) AS mean_s FROM c GROUP BY ROLLUP(y)", ("kv",))
def _(s):
    c = sidecars.note_fields(s.kv).select((F.col("clip_id") % 6).alias("y"), "duration")
    return _round(co.hours_by_class(c), "hours", "mean_s")


@query("skip_existing", "SELECT path, CASE WHEN length > 30000 THEN 'exists' ELSE 'to_do' END AS status FROM manifest", ("manifest",))
def _(s):
    return stores.skip_existing(s.manifest.select("path"), s.manifest.filter("length > 30000"))


@query("pending_sessions", f"WITH {_SES} SELECT DISTINCT session_key FROM ses WHERE session_key NOT IN (SELECT session_key FROM ses WHERE path LIKE '%Stage_5%')", ("manifest",))
def _(s):
    ses = s.manifest.select(pt.session_of(pt.clip_dir(F.col("path"))).alias("session_key"), "path")
    return stores.pending(ses.select("session_key").distinct(), ses.filter(F.col("path").contains("Stage_5")).distinct(), "session_key")


@query("find_source", """
WITH a AS (SELECT p_partkey % 2 AS root_ord, p_partkey % 3 AS layout, '/r' || (p_partkey % 2) || '/RN' || (p_partkey % 5) || '/d/' || (p_partkey % 500) || '.edf' AS path, (p_partkey % 500) || '.edf' AS name FROM part),
w AS (SELECT DISTINCT (p_partkey % 700) || '.edf' AS name, 'RN' || (p_partkey % 700 % 5) AS subject FROM part)
SELECT w.name, w.subject, arg_min(path, (root_ord, layout, path)) FILTER (path IS NOT NULL AND (layout <> 0 OR path LIKE '%/' || subject || '/%')) AS source_path
FROM w LEFT JOIN a ON a.name = w.name GROUP BY w.name, w.subject""")
def _(s):
    k = F.col("p_partkey")
    t = lambda c: c.cast("string")
    a = s.part.select((k % 2).alias("root_ord"), (k % 3).alias("layout"),
                      F.concat(F.lit("/r"), t(k % 2), F.lit("/RN"), t(k % 5), F.lit("/d/"), t(k % 500), F.lit(".edf")).alias("path"))
    w = s.part.select(F.concat(t(k % 700), F.lit(".edf")).alias("name"), F.concat(F.lit("RN"), t(k % 700 % 5)).alias("subject")).distinct()
    return stores.find_source(w, a)


@query("crop_boxes", """
WITH g AS (SELECT * FROM (VALUES ('RN199', 0.5, 0.1, 0.7, 0.2), ('RN203', 0.33, 0.25, 0.9, 0.05)) AS t(subject, wf, xf, hf, yf)),
i AS (SELECT file_id, regexp_extract(path, 'RN[0-9]{3}') AS subject, 640 + file_id % 7 AS width, 480 + file_id % 5 AS height FROM manifest)
SELECT file_id, (floor(width * coalesce(xf, 0.0)::DOUBLE / 2) * 2)::INT AS crop_x, (floor(height * coalesce(yf, 0.0)::DOUBLE / 2) * 2)::INT AS crop_y,
       (floor(width * coalesce(wf, 1.0)::DOUBLE / 2) * 2)::INT AS crop_w, (floor(height * coalesce(hf, 1.0)::DOUBLE / 2) * 2)::INT AS crop_h FROM i LEFT JOIN g USING (subject)""", ("manifest",))
def _(s):
    g = s.spark.createDataFrame([("RN199", 0.5, 0.1, 0.7, 0.2), ("RN203", 0.33, 0.25, 0.9, 0.05)], "subject string, width_frac double, x_frac double, height_frac double, y_frac double")
    i = s.manifest.select("file_id", pt.subject_of(F.col("path")).alias("subject"), (F.lit(640) + F.col("file_id") % 7).alias("width"), (F.lit(480) + F.col("file_id") % 5).alias("height"))
    return co.crop_boxes(i, g).select("file_id", "crop_x", "crop_y", "crop_w", "crop_h")


# ---- sidecar text and names -----------------------------------------------

@query("name_timestamp", """
WITH d AS (SELECT file_id, regexp_extract(name, '([0-9]{14})', 1) AS a, regexp_extract(name, '([0-9]{12})', 1) AS b FROM filename)
SELECT file_id, epoch(coalesce(try_strptime(a, '%Y%m%d%H%M%S'), try_strptime(b, '%Y%m%d%H%M')))::DOUBLE AS start_s FROM d""", ("filename",))
def _(s):
    return s.filename.select("file_id", tf.epoch(tf.name_timestamp(F.col("name"))).alias("start_s"))


@query("edf_name_date", r"""
WITH d AS (SELECT file_id, regexp_extract(name, '\((\d{1,2})-(\d{1,2})\s+to\s+\d{1,2}-\d{1,2}\)', ['m', 'd']) AS r, regexp_extract(name, '(\d{4})(\d{2})(\d{2})', ['y', 'm', 'd']) AS f FROM filename)
SELECT file_id, epoch(coalesce(try_strptime('2022-' || r.m || '-' || r.d, '%Y-%m-%d'), try_strptime(f.y || '-' || f.m || '-' || f.d, '%Y-%m-%d')))::DOUBLE AS start_s FROM d""", ("filename",))
def _(s):
    return s.filename.select("file_id", tf.epoch(tf.edf_name_date(F.col("name"), 2022)).alias("start_s"))


def _starts(s):
    f = s.filename
    return f.withColumn("xml_s", F.when(F.col("file_id") % 3 == 0, 1_700_000_000 + F.col("file_id"))).withColumn(
        "header_s", F.when(F.col("file_id") % 4 == 0, 1_600_000_000 + F.col("file_id")))


_START = r"""
WITH d AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN (1700000000 + file_id)::DOUBLE END AS x, CASE WHEN file_id % 4 = 0 THEN (1600000000 + file_id)::DOUBLE END AS h,
       regexp_extract(name, '([0-9]{14})', 1) AS a, regexp_extract(name, '([0-9]{12})', 1) AS b,
       regexp_extract(name, '\((\d{1,2})-(\d{1,2})\s+to\s+\d{1,2}-\d{1,2}\)', ['m', 'd']) AS r, regexp_extract(name, '(\d{4})(\d{2})(\d{2})', ['y', 'm', 'd']) AS f FROM filename),
n AS (SELECT file_id, x, h, epoch(coalesce(try_strptime(a, '%Y%m%d%H%M%S'), try_strptime(b, '%Y%m%d%H%M'), try_strptime('2022-' || r.m || '-' || r.d, '%Y-%m-%d'),
      try_strptime(f.y || '-' || f.m || '-' || f.d, '%Y-%m-%d')))::DOUBLE AS v FROM d)
"""


@query("start_time_lenient", _START + "SELECT file_id, coalesce(x, h, v) AS start_s, CASE WHEN x IS NOT NULL THEN 'xml' WHEN h IS NOT NULL THEN 'header' WHEN v IS NOT NULL THEN 'filename' ELSE 'none' END AS source FROM n", ("filename",))
def _(s):
    return sidecars.start_time(_starts(s), strict=False).select("file_id", "start_s", "source")


@query("start_time_strict", _START + "SELECT file_id, coalesce(x, h) AS start_s, CASE WHEN x IS NOT NULL THEN 'xml' WHEN h IS NOT NULL THEN 'header' ELSE 'none' END AS source FROM n", ("filename",))
def _(s):
    return sidecars.start_time(_starts(s), strict=True).select("file_id", "start_s", "source")


@query("xml_start", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1700000000 + o_custkey END AS start_s FROM orders")
def _(s):
    doc = F.concat(F.lit("<rec><a>1</a>"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("<DSI_utc_start_time> </DSI_utc_start_time>")).otherwise(
        F.concat(F.lit("<DSI_utc_start_time> "), (F.col("o_custkey") + 1_700_000_000).cast("string"), F.lit(" </DSI_utc_start_time>"))), F.lit("</rec>"))
    return s.orders.select("o_orderkey", sidecars.xml_start(doc).alias("start_s"))


@query("note_fields", """SELECT clip_id, 'Stage ' || (clip_id % 6) AS label, regexp_extract(body, 'Duration \\(s\\) : ([0-9]+)', 1)::DOUBLE AS duration,
CASE WHEN body LIKE '%Pre-buffer%' THEN 10.0 END AS pre_buffer FROM kv""", ("kv",))
def _(s):
    return sidecars.note_fields(s.kv).select("clip_id", "label", "duration", "pre_buffer")


@query("event_offsets", """
SELECT o_orderkey AS clip_id, CASE WHEN o_orderkey % 4 = 0 THEN (o_custkey % 50)::DOUBLE + 0.25 WHEN o_orderkey % 4 <> 1 THEN 10.0 END AS rel_start,
       CASE WHEN o_orderkey % 4 = 0 THEN (o_custkey % 50)::DOUBLE + 5.25 WHEN o_orderkey % 4 <> 1 THEN 10.0 + o_custkey % 90 END AS rel_end FROM orders""")
def _(s):
    day = lambda sec: F.date_format(F.timestamp_micros(((F.lit(1_700_000_000.0) + sec) * 1_000_000).cast("bigint")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    whole = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000)), "yyyy-MM-dd HH:mm:ss")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    body = F.when(k % 4 == 0, F.concat(F.lit("Clip start : "), whole, F.lit("\nSeizure start  : "), day(c % 50 + 0.25), F.lit("\nSeizure end : "), day(c % 50 + 5.25))).otherwise(
        F.concat(F.lit("Duration (s) : "), (c % 90).cast("string"), F.when(k % 4 == 1, "").otherwise("\nPre-buffer (s) : 10")))
    f = sidecars.note_fields(s.orders.select(k.alias("clip_id"), body.alias("body")))
    return sidecars.event_offsets(f).select("clip_id", "rel_start", F.when(F.col("rel_start").isNotNull(), F.col("rel_end")).alias("rel_end"))


@query("build_parameters", "SELECT p_partkey, (p_size % 9)::DOUBLE AS win, p_size / 4.0::DOUBLE AS stride, (p_size % 16)::DOUBLE AS decim FROM part")
def _(s):
    n = F.col("p_size")
    line = F.concat(F.lit("built win="), (n % 9).cast("string"), F.lit("s stride="), (n / 4.0).cast("string"), F.lit("s decim="), (n % 16).cast("string"), F.lit(" ok"))
    return s.part.select("p_partkey", sidecars.build_parameters(line).alias("b")).select("p_partkey", "b.*")


@query("normalise_sheet", """
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 0 THEN 'Unknown' ELSE 'Stage ' || (o_orderkey % 6) END AS label,
       CASE WHEN o_orderkey % 5 = 0 THEN 30.0 ELSE (o_custkey % 90)::DOUBLE END AS duration,
       CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE epoch(o_orderdate) END::DOUBLE AS start_s,
       CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE epoch(o_orderdate) + CASE WHEN o_orderkey % 5 = 0 THEN 30.0 ELSE o_custkey % 90 END END::DOUBLE AS end_s,
       CASE WHEN o_orderkey % 13 = 0 THEN 'no_start' WHEN o_orderkey % 11 = 0 THEN 'unit_row' ELSE 'ok' END AS reason FROM orders""")
def _(s):
    k = F.col("o_orderkey")
    sheet = s.orders.select(
        k.alias("row_id"), F.when(k % 7 != 0, F.concat(F.lit("Stage "), (k % 6).cast("string"))).alias("Event Stage"),
        F.when(k % 5 == 0, "[s]").otherwise((F.col("o_custkey") % 90).cast("string")).alias("Length (s)"),
        F.when(k % 13 == 0, None).when(k % 11 == 0, "[s]").otherwise(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss")).alias("Start Time"))
    out = sheets.normalise_sheet(sheet, order="row_id")
    return out.select("row_id", "label", "duration", tf.epoch(F.col("start")).alias("start_s"), tf.epoch(F.col("end")).alias("end_s"), "reason")


# ---- records ---------------------------------------------------------------

_KEY = r"regexp_replace(lower(regexp_replace(coalesce(title, ''), '<[^>]+>', ' ', 'g')), '[^a-z0-9]', '', 'g')"


@query("title_keys", f"SELECT doc_id, md5({_KEY}) AS key_md5, length({_KEY}) AS key_len FROM record", ("record",))
def _(s):
    return s.record.select("doc_id", F.md5(tx.title_key(F.col("title"))).alias("key_md5"), F.length(tx.title_key(F.col("title"))).cast("bigint").alias("key_len"))


@query("merge_records", f"""
WITH k AS (SELECT *, {_KEY} AS key FROM record), k2 AS (SELECT *, sha256(key) AS title_digest FROM k WHERE length(key) >= 12),
src AS (SELECT title_digest, source_api, min(doc_id) AS o FROM k2 GROUP BY ALL), j AS (SELECT title_digest, string_agg(source_api, '+' ORDER BY o) AS sources FROM src GROUP BY title_digest)
SELECT title_digest, min(doc_id) AS doc_id, count(*) AS n_records, max(cited_by_count) AS cited_by_count, any_value(j.sources) AS sources, arg_min(topic, doc_id) AS topic
FROM k2 JOIN j USING (title_digest) GROUP BY title_digest""", ("record",))
def _(s):
    return rc.merge_records(s.record, "doc_id", ("topic",)).select("title_digest", "doc_id", "n_records", "cited_by_count", "sources", "topic")


@query("merged_record_ids", f"""
WITH k AS (SELECT *, {_KEY} AS key FROM record), k2 AS (SELECT *, sha256(key) AS title_digest FROM k WHERE length(key) >= 12),
src AS (SELECT title_digest, source_api, min(doc_id) AS o FROM k2 GROUP BY ALL)
SELECT title_digest, string_agg('r' || o, ' | ' ORDER BY o) AS record_ids FROM src GROUP BY title_digest""", ("record",))
def _(s):
    named = s.record.withColumn("record_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")))
    return rc.merge_records(named, "doc_id", ident="record_id").select("title_digest", "record_ids")


@query("merged_queries", f"""
WITH k AS (SELECT *, {_KEY} AS key FROM record), k2 AS (SELECT *, sha256(key) AS title_digest FROM k WHERE length(key) >= 12)
SELECT title_digest, doc_id, 'query ' || (doc_id % 9) AS source_query FROM k2 QUALIFY doc_id > min(doc_id) OVER (PARTITION BY title_digest)""", ("record",))
def _(s):
    asked = s.record.withColumn("source_query", F.concat(F.lit("query "), (F.col("doc_id") % 9).cast("string")))
    return rc.also_queries(asked, "doc_id")


@query("count_records", "SELECT topic, count(*) AS n, count(*) FILTER (doc_id % 3 <> 0) AS with_doi FROM record GROUP BY topic", ("record",))
def _(s):
    r = s.record.withColumn("doi", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).otherwise(""))
    return rc.count_records(r, "topic", "doi")


# topics over the invented prose of the given documents
_TOPICS = {"english": rc.Topic((r"\bthe\b", r"\band\b"), ("tion", "ing", "er")), "french": rc.Topic((r"\ble\b", r"\bla\b", r"\bdes\b"), ("eau", "oui"))}


def _topic_sql(name, t):
    h = lambda ps: " + ".join(f"regexp_matches(t, '{p}')::INT" for p in ps)
    return (f"SELECT doc_id, '{name}' AS topic, ({h(t.must)}) AS m, ({h(t.must)}) * 3.0::DOUBLE + ({h(t.bonus)}) "
            "+ CASE WHEN c > 0 THEN least(c, 3000)::DOUBLE ** 0.35 ELSE 0.0 END + CASE WHEN doc_id % 20 + 2005 >= 2015 THEN 1.5 ELSE 0.0 END + CASE WHEN t <> '' THEN 0.5 ELSE 0.0 END "
            f"- CASE WHEN regexp_matches(t, 'retract|erratum|correction to|editorial|comment on') THEN 15.0 ELSE 0.0 END AS score FROM d")


@query("top_per_topic", "WITH d AS (SELECT doc_id, lower(title) AS t, cited_by_count AS c FROM record), a AS (" + " UNION ALL ".join(_topic_sql(n, t) for n, t in _TOPICS.items()) + """),
b AS (SELECT doc_id, topic, round(score, 6) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, doc_id) AS place FROM a WHERE m > 0 AND score > 0)
SELECT doc_id, topic, score, place FROM b WHERE place <= 28""", ("record",))
def _(s):
    r = s.record.withColumn("year", F.lit(2005) + F.col("doc_id") % 20)
    return _round(rc.top_per_topic(
        r, _TOPICS, 28, "doc_id", F.col("title"), F.col("title"), F.col("cited_by_count"), year=F.col("year"), abstract=F.col("abstract")
    ), "score")


_SHORT = {"mixed": rc.Topic((), ("eau", "tion"), (("title", ("the", "des")), ("text", ("ation", "oui"))), ("license", "secret"))}


@query("shortlist_records", f"""WITH d AS (SELECT doc_id, lower(title) AS t, cited_by_count AS c FROM record),
s AS (SELECT doc_id, least(c, 8000)::DOUBLE ** 0.4 + 2.0::DOUBLE * (regexp_matches(t, 'eau')::INT + regexp_matches(t, 'tion')::INT) + CASE WHEN doc_id % 20 + 2005 >= 2015 THEN 3.0 ELSE 0.0 END
      + CASE WHEN doc_id % 20 + 2005 >= 2019 THEN 2.0 ELSE 0.0 END + CASE WHEN t <> '' THEN 1.5 ELSE 0.0 END - CASE WHEN regexp_matches(t, 'retract|erratum|correction to|^comment on|editorial|author correction|supplementary|abstracts? from|conference abstract') THEN 60.0 ELSE 0.0 END AS score
      FROM d WHERE regexp_matches(t, 'the|des') AND regexp_matches(t, 'ation|oui') AND NOT regexp_matches(t, 'license|secret'))
SELECT doc_id, 'mixed' AS topic, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS place FROM s
QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) <= 30""", ("record",))
def _(s):
    return _round(rc.top_per_topic(
        s.record.withColumn("year", F.lit(2005) + F.col("doc_id") % 20), _SHORT, 30, "doc_id", F.col("title"), F.col("title"), F.col("cited_by_count"),
        "shortlist", year=F.col("year"), abstract=F.col("abstract")
    ), "score")


@query("relevant_records", "SELECT doc_id FROM record WHERE regexp_matches(lower(title), 'ation') AND regexp_matches(lower(title), 'the|des') AND NOT regexp_matches(lower(title), 'license|secret')", ("record",))
def _(s):
    topic = rc.Topic(("ation",), groups=(("title", ("the", "des")),), exclude=("license", "secret"))
    return s.record.filter(rc.relevant(topic, F.lower("title"), F.lower("title"))).select("doc_id")


# rankings by titles, and a strict one whose rules have alternatives
@query("title_ranking", """WITH d AS (SELECT doc_id, lower(title) AS t, cited_by_count AS c FROM record),
s AS (SELECT doc_id, least(greatest(c, 0), 5000)::DOUBLE ** 0.4 + CASE WHEN doc_id % 20 + 2005 >= 2015 THEN 4.0 ELSE 0.0 END + CASE WHEN doc_id % 20 + 2005 >= 2020 THEN 2.0 ELSE 0.0 END
      + CASE WHEN t <> '' THEN 1.0 ELSE 0.0 END - CASE WHEN regexp_matches(t, 'retract|erratum|correction to|editorial|^comment') THEN 50.0 ELSE 0.0 END AS score
      FROM d WHERE (regexp_matches(t, 'tion') AND regexp_matches(t, 'eau|the')) OR regexp_matches(t, 'ung|keit'))
SELECT doc_id, 'either' AS topic, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS place FROM s
QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) <= 25""", ("record",))
def _(s):
    either = rc.Topic(any_of=(rc.Topic(groups=(("title", ("tion",)), ("title", ("eau", "the")))), rc.Topic(groups=(("title", ("ung", "keit")),))))
    return _round(rc.top_per_topic(
        s.record.withColumn("year", F.lit(2005) + F.col("doc_id") % 20), {"either": either}, 25, "doc_id", F.col("title"), F.col("title"), F.col("cited_by_count"),
        "titles", year=F.col("year"), abstract=F.col("abstract")
    ), "score")


@query("strict_ranking", """WITH d AS (SELECT doc_id, lower(title) AS t, cited_by_count AS c FROM record),
s AS (SELECT doc_id, least(greatest(c, 0), 5000)::DOUBLE ** 0.4 + 3.0::DOUBLE * (regexp_matches(t, 'ing')::INT + regexp_matches(t, 'ment')::INT)
      + CASE WHEN doc_id % 20 + 2005 >= 2015 THEN 4.0 ELSE 0.0 END + CASE WHEN doc_id % 20 + 2005 >= 2020 THEN 3.0 ELSE 0.0 END AS score
      FROM d WHERE regexp_matches(t, 'er|le') AND NOT regexp_matches(t, 'license'))
SELECT doc_id, 'strict' AS topic, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS place FROM s
QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) <= 45""", ("record",))
def _(s):
    strict = rc.Topic((), ("ing", "ment"), (("title", ("er", "le")),), ("license",))
    return _round(rc.top_per_topic(
        s.record.withColumn("year", F.lit(2005) + F.col("doc_id") % 20), {"strict": strict}, 45, "doc_id", F.col("title"), F.col("title"), F.col("cited_by_count"), "strict", year=F.col("year")
    ), "score")


_STOP = ", ".join(f"'{w}'" for w in tx.KEY_STOP_WORDS)


@query("citation_keys", f"""
WITH a AS (SELECT doc_id, lower(regexp_replace(strip_accents(list_extract(string_split_regex(trim('Anne ' || source_api), '\\s+'), -1)), '[^a-zA-Z]', '', 'g')) AS sur, 2000 + doc_id % 20 AS yr,
  list_filter(string_split_regex(regexp_replace(regexp_replace(title, '<[^>]+>', '', 'g'), '[^a-zA-Z ]', ' ', 'g'), ' +'), lambda w: length(w) > 3 AND lower(w) NOT IN ({_STOP})) AS ws FROM record),
k AS (SELECT doc_id, sur || yr || coalesce(lower(ws[1]), 'x') AS stem FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS n FROM k)
SELECT doc_id, stem || CASE WHEN n = 1 THEN '' WHEN n <= 27 THEN chr((n + 95)::INT) ELSE '_' || n END AS cite_key FROM n""", ("record",))
def _(s):
    return rc.citation_keys(s.record, "doc_id", F.concat(F.lit("Anne "), F.col("source_api")), F.lit(2000) + F.col("doc_id") % 20, F.col("title"))


@query("text_from_inverted", "SELECT conv_id, turn, md5(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ')) AS text_md5 FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def _(s):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    pos = s.conversations.select("conv_id", "turn", F.posexplode(words).alias("pos", "word"))
    index = pos.groupBy("conv_id", "turn", "word").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    docs = index.groupBy("conv_id", "turn").agg(F.collect_list(F.struct("word", "positions")).alias("index"))
    return docs.select("conv_id", "turn", F.md5(tx.from_inverted(F.col("index"))).alias("text_md5"))


@query("arxiv_ids", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '2101.' || lpad((page_id % 10000)::VARCHAR, 5, '0') WHEN page_id % 3 = 1 THEN '1902.' || lpad((page_id % 10000)::VARCHAR, 4, '0') ELSE '' END AS arxiv FROM pages""")
def _(s):
    p = F.col("page_id")
    num = lambda n: F.lpad((p % 10000).cast("string"), n, "0")
    urls = F.array(F.col("url"), F.when(p % 3 == 0, F.concat(F.lit("https://arxiv.org/pdf/2101."), num(5))))
    doi = F.when(p % 3 == 1, F.concat(F.lit("10.48550/ARXIV.1902."), num(4)))
    return s.pages.select("page_id", tx.arxiv_id(urls, doi).alias("arxiv"))


@query("verify_keys", """WITH f AS (SELECT doc_id, '10.1/' || (CASE WHEN doc_id % 9 = 0 THEN -doc_id - 1 ELSE doc_id END) AS doi FROM record)
SELECT f.doc_id, CASE WHEN r.doc_id IS NULL THEN 'NOT_FOUND' ELSE 'verified' END AS status FROM f LEFT JOIN record r ON f.doi = '10.1/' || r.doc_id""", ("record",))
def _(s):
    f = s.record.select("doc_id", F.concat(F.lit("https://doi.org/10.1/"), F.when(F.col("doc_id") % 9 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")).alias("doi"))
    c = s.record.select(F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"))
    return rc.verify_keys(f, c).select("doc_id", "status")


@query("venue_notes", "SELECT doc_id, CASE source WHEN 'src1' THEN 'abbrev: S. One' WHEN 'src2' THEN 'abbrev: S. Two' END AS note FROM documents")
def _(s):
    ab = s.spark.createDataFrame([("src1", "S. One"), ("src2", "S. Two"), ("src3", "src3")], "venue string, abbrev string")
    return rc.venue_notes(s.documents.select("doc_id", F.col("source").alias("venue")), ab).select("doc_id", "note")


# ---- streams ---------------------------------------------------------------

def _sink(s) -> tuple[str, str]:
    base = scratch_path(s.spark)
    return f"{base}/out", f"{base}/state"


@query("stream_events", f"WITH {det_sql()} SELECT session, modality, thr, {r6s('t_start', 't_end', 'peak')}, n_hits FROM det", ("trace",))
def _(s):
    def scores(e):
        return e.select(F.col("user_id").alias("session"), F.when(F.col("event_id") % 2 == 0, "video").otherwise("eeg").alias("modality"),
                        F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / (F.col("value") + 50.0)).alias("p"))

    out, state = _sink(s)
    source = s.spark.readStream.schema(s.events.schema).option("pathGlobFilter", "events.parquet").parquet(s.sf_dir)
    stream = st.stream_events(scores(source), ev.THRESHOLDS, WIN, MIN_DUR, GAP)
    st.drain(stream, out, state)
    closed = s.spark.read.schema(stream.schema).parquet(out)
    rest = st.open_events(s.spark, state, stream, WIN, MIN_DUR)  # from the stream's state
    return _round(closed.unionByName(rest), "t_start", "t_end", "peak")


@query("stream_new_sessions", f"WITH {_SES} SELECT DISTINCT session_key FROM ses", ("manifest",))
def _(s):
    p = s.spark.readStream.schema(s.part.schema).option("pathGlobFilter", "part.parquet").parquet(s.sf_dir)
    key = F.concat(F.lit("RN"), (F.lit(197) + F.col("p_partkey") % 20).cast("string"), F.lit("/s"), (F.col("p_partkey") % 40).cast("string"))
    stream = st.new_sessions(p.select(key.alias("session_key")))
    out, state = _sink(s)
    st.drain(stream, out, state)
    return s.spark.read.schema(stream.schema).parquet(out)


@query("window_store", "SELECT clip_id, w_idx, wlab, true AS without_path FROM window_v", ("window_v",))
def _(s):
    path = scratch_path(s.spark)
    s.window_v.write.parquet(path)
    return stores.read_windows(s.spark, path).select("clip_id", "w_idx", "wlab", F.col("clip_path").isNull().alias("without_path"))


def _stored_predictions(s):
    path = scratch_path(s.spark)
    s.prediction.write.partitionBy("run_id").parquet(path)
    return stores.read_predictions(s.spark, path, ("path", "sub", "part"))


def _prediction_rows(s, kept):
    return kept.select(F.col("run_id").cast(s.prediction.schema["run_id"].dataType).alias("run_id"), "clip", "y", "pred", F.col("part").isNull().alias("without_part"))


@query("prediction_store", "SELECT run_id, clip, y, pred, true AS without_part FROM prediction", ("prediction",))
def _(s):
    return _prediction_rows(s, _stored_predictions(s))


@query("prediction_store_runs", "SELECT run_id, clip, y, pred, true AS without_part FROM prediction", ("prediction",))
def _(s):
    return _prediction_rows(s, _stored_predictions(s))


@query("append_log", f"WITH {_SES} SELECT DISTINCT session_key, session_key LIKE '%/s1%' AS first_batch FROM ses", ("manifest",))
def _(s):
    """Two batches that overlap, each run twice: every session is logged once, with the first batch it came in."""
    path = scratch_path(s.spark)
    ses = s.manifest.select(pt.session_of(pt.clip_dir(F.col("path"))).alias("session_key"))
    for rows, batch in ((ses.filter("session_key LIKE '%/s1%'"), 1), (ses, 2)) * 2:
        stores.append_log(rows, path, "session_key", batch)
    return stores.read_log(s.spark, path).select("session_key", (F.col("batch") == "1").alias("first_batch"))


@query("logged_sessions", f"WITH {_SES} SELECT DISTINCT session_key FROM ses", ("manifest",))
def _(s):
    path = scratch_path(s.spark)
    p = s.spark.readStream.schema(s.part.schema).option("pathGlobFilter", "part.parquet").parquet(s.sf_dir)
    key = F.concat(F.lit("RN"), (F.lit(197) + F.col("p_partkey") % 20).cast("string"), F.lit("/s"), (F.col("p_partkey") % 40).cast("string"))
    for replay in range(2):  # the second stream starts from nothing again
        stores.log_stream(p.select(key.alias("session_key")), path, f"{path}/state{replay}", "session_key")
    return stores.read_log(s.spark, path).select("session_key")


@query("sheet_ordinal", """
SELECT o_orderkey AS row_id, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS idx, 'Stage ' || (o_orderkey % 6) AS label, epoch(o_orderdate)::DOUBLE AS start_s
FROM orders""")
def _(s):
    path, k = scratch_path(s.spark), F.col("o_orderkey")
    sheet = s.orders.select(
        (k % 8).alias("part"), k.cast("string").alias("row_id"), F.concat(F.lit("Stage "), (k % 6).cast("string")).alias("Event Stage"),
        F.date_format(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("Start Time"), k)
    sheet.repartition("part").sortWithinPartitions("part", "o_orderkey").drop("o_orderkey").write.partitionBy("part").option("header", True).csv(path)
    out = sheets.read_sheet(s.spark, path)
    return out.select(F.col("row_id").cast("bigint").alias("row_id"), "idx", "label", tf.epoch(F.col("start")).alias("start_s"))
