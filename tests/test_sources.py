"""Sidecars, sheets, stores, records, streams and the catalogue."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoline.functions import text as tx, timefmt as tf
from chronoline.operators import clips, cohort, events as ev, records as rc
from chronoline.sources import sheets, sidecars, stores
from chronoline.streaming import events as st


def test_sheet_headers_units_and_defaults(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Seizure Stage,Length,Start Time,End Time,Spikes\n,[s],[s],,\nStage 3,12.5,2024-01-01 10:00:00,,4\n,,2024-01-01 11:00:00.5,2024-01-01 11:02:00,\nStage 2,x,10:30:00,,\nS,1,,,\n"
    )
    rows = sheets.read_sheet(spark, str(tmp_path / "a.csv")).collect()
    by = {str(r["start"]): r for r in rows if r["start"]}
    a = by["2024-01-01 10:00:00"]
    assert a["label"] == "Stage 3" and str(a["end"]) == "2024-01-01 10:00:12.500000" and a["spikes"] == 4
    b = by["2024-01-01 11:00:00.500000"]
    assert b["label"] == "Unknown" and b["duration"] == 30.0 and str(b["end"]) == "2024-01-01 11:02:00"
    assert sorted(r["reason"] for r in rows) == ["no_day", "no_start", "ok", "ok", "unit_row"]
    day = spark.createDataFrame([("10:30:00", "2024-05-06")], "start string, day string")
    assert str(sheets.normalise_sheet(day, "day").collect()[0]["start"]) == "2024-05-06 10:30:00"
    with pytest.raises(ValueError):
        sheets.normalise_sheet(spark.createDataFrame([("x",)], "label string"))


def test_names_and_clocks(spark):
    names = ["RN1.20240230101010.mp4", "RN1.202402281010.mp4", "RN140-22 (12-13 to 12-15).edf", "RN103-22 (10-28).edf", "RN103_20221028.edf", "none"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", tf.name_timestamp(F.col("n")).cast("string").alias("a"), tf.edf_name_date(F.col("n"), 2022).cast("string").alias("b"))
    got = {r["n"]: (r["a"], r["b"]) for r in df.collect()}
    assert got[names[1]][0] == "2024-02-28 10:10:00" and got[names[5]] == (None, None)
    assert [got[n][1] for n in names[2:5]] == ["2022-12-13 00:00:00", "2022-10-28 00:00:00", "2022-10-28 00:00:00"]
    h = spark.createDataFrame([(-5.0,), (59.9,), (3723.0,), (400000.0,)], "s double").select(tf.hms(F.col("s")).alias("h")).collect()
    assert [r["h"] for r in h] == ["00:00:00", "00:00:59", "01:02:03", "111:06:40"]


def test_sidecar_files(spark, tmp_path):
    d = tmp_path / "s1" / "clip_a"
    d.mkdir(parents=True)
    (d / "info.txt").write_text("Label : Stage 3\nClip start : 2024-01-01 10:00:00\nSeizure start : 2024-01-01 10:00:10.5\nSeizure end : 2024-01-01 10:00:20\nno colon here\nLabel : Stage 4\n")
    (d / "v.XML").write_text("<r><DSI_utc_start_time> 1700000000 </DSI_utc_start_time></r>")
    (d / "v.xml").write_text("<r><DSI_utc_start_time>5</DSI_utc_start_time></r>")
    (d / "w.xml").write_text("<r><broken")
    f = sidecars.event_offsets(sidecars.note_fields(sidecars.read_notes(spark, str(tmp_path)))).collect()[0]
    assert (f["label"], f["rel_start"], f["rel_end"]) == ("Stage 4", 10.5, 20.0) and f["clip"].endswith("clip_a")
    x = {r["stem_path"].rsplit("/", 1)[-1]: r["start_s"] for r in sidecars.read_xml_starts(spark, str(tmp_path)).collect()}
    assert x == {"v": 1700000000, "w": None}
    files = stores.read_manifest(spark, str(tmp_path))
    assert files.count() == 4 and set(files.columns) == {"path", "length", "modified"}
    assert stores.read_manifest(spark, str(tmp_path), "*.txt").count() == 1


def test_note_offsets_fall_back(spark):
    rows = [("Duration (s) : 5\nPre-buffer (s) : 10",), ("Duration (s) : 5",), ("Clip start : bad\nSeizure start : 1\nSeizure end : 2",)]
    f = sidecars.event_offsets(sidecars.note_fields(spark.createDataFrame(rows, "body string"))).collect()
    assert [(r["rel_start"], r["rel_end"]) for r in f] == [(10.0, 15.0), (None, None), (None, None)]


def test_numbering_and_window_store(spark, tmp_path):
    names = [f"c{i * 7919 % 300:03d}" for i in range(300)]
    df = spark.createDataFrame([(n, w) for n in names for w in (0, 1)], "clip_path string, w_idx int").repartition(6)
    stores.write_windows(df, str(tmp_path / "w"))
    back = stores.read_windows(spark, str(tmp_path / "w"), ("clip_path", "extra"))
    ids = {r["clip_path"]: r["clip_id"] for r in back.collect()}
    assert ids == {n: i for i, n in enumerate(sorted(names))} and "extra" in back.columns


def test_logs_resume_and_documents(spark, tmp_path):
    sessions = spark.createDataFrame([(1,), (2,), (3,)], "session int")
    log = str(tmp_path / "log")
    stores.append_log(sessions.filter("session = 1"), log)
    stores.append_log(sessions.filter("session = 3"), log)
    assert [r["session"] for r in stores.pending(sessions, stores.read_log(spark, log)).collect()] == [2]
    ann = spark.createDataFrame([(1, 0, 5.0)], "session int, idx int, t double")
    qc = spark.createDataFrame([(1, 4), (2, 0)], "session int, n int")
    trace = spark.createDataFrame([(1, "v", 0.0, 0.5)], "session int, modality string, t double, p double")
    stores.write_session_results(stores.session_documents(ann, qc), trace, ann, ann, str(tmp_path / "r"))
    got = {r["session"]: r for r in spark.read.json(str(tmp_path / "r/documents")).collect()}
    assert got[1]["qc"]["n"] == 4 and got[1]["sweep"][0]["t"] == 5.0 and got[2]["sweep"] is None
    assert spark.read.parquet(str(tmp_path / "r/trace")).columns == ["t", "p", "session", "modality"]
    stores.write_log(ann, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["session", "idx", "t"]


def test_nested_results(spark, tmp_path):
    from chronoline.operators.runs import macro_of_map

    (tmp_path / "run7").mkdir()
    (tmp_path / "run7" / "results.json").write_text(json.dumps({"macro_f1": 0.5, "per_class": {"a": {"precision": 0.2, "recall": 1.0}, "b": {"precision": 0.6, "recall": 0.0}}}, indent=1))
    r = macro_of_map(stores.read_results(spark, str(tmp_path / "*/results.json"), ("a", "b")), "precision").collect()[0]
    assert r["macro_precision"] == pytest.approx(0.4) and r["run"] == "run7"


def test_records(spark):
    rows = [(1, "A <i>Deep</i> Seizure Study!", "oa", 3, "", 2020), (2, "a deep seizure   study", "dblp", 9, "10.1/x", 2021), (3, "Short", "oa", 1, "", 2000), (4, "A deep seizure study", "oa", 2, "10.1/y", 2020)]
    df = spark.createDataFrame(rows, "id int, title string, source_api string, cited_by_count int, doi string, year int")
    m = rc.merge_records(df, "id", ("doi",)).collect()
    assert len(m) == 1 and m[0]["n_records"] == 3
    assert (m[0]["id"], m[0]["cited_by_count"], m[0]["sources"], m[0]["doi"]) == (1, 9, "oa+dblp", "10.1/x")
    keys = rc.citation_keys(df, "id", F.lit("José Núñez-Ávila"), F.lit(2020), F.lit("From deep nets to mice")).orderBy("id").collect()
    assert [k["cite_key"] for k in keys] == ["nunezavila2020deep", "nunezavila2020deepa", "nunezavila2020deepb", "nunezavila2020deepc"]
    t = {"x": rc.Topic(("seizure",), ("deep",))}
    top = rc.top_per_topic(df, t, 2, "id", F.col("title"), F.col("title"), F.col("cited_by_count"), year=F.col("year")).orderBy("place").collect()
    assert [r["id"] for r in top] == [2, 1]
    one = rc.top_per_topic(df, rc.TOPICS, 5, "id", F.col("title"), F.col("title"), F.col("cited_by_count")).collect()
    assert one == []
    u = spark.createDataFrame([([None, "http://arxiv.org/abs/2101.00001v2"],)], "u array<string>").select(tx.arxiv_id(F.col("u")).alias("a")).collect()
    assert u[0]["a"] == "2101.00001"


def test_copy_comparison_and_labels(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "path string, length int")
    b = spark.createDataFrame([("x", 1), ("y", 5), ("w", 1)], "path string, length int")
    got = {r["status"]: r["files"] for r in cohort.reconcile(a, b).collect()}
    assert got == {"same": 1, "size_differs": 1, "missing": 1, "extra": 1, None: 4}
    lab = spark.createDataFrame([(1, "Stage 3"), (1, "spikes"), (1, None), (1, "Stage 5")], "session int, label string")
    r = clips.label_counts(lab, keep=("stage 3",)).collect()[0]
    assert (r["total"], r["kept"], r["excluded"]) == (4, 1, 3)


def test_stream_agrees_with_batch_at_gap_equality(spark, tmp_path):
    t = [0.0, 8.0, 16.000001, 40.0, 90.0, 1000.0]
    df = spark.createDataFrame([(1, "v", x, 0.9) for x in t], "session int, modality string, t double, p double")
    src = df.select("session", "modality", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")).alias("ts"), "p")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.stream_events(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), (0.5,), watermark="10 seconds")
    st.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["t_start"], r["t_end"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r["t_start"], r["t_end"]) for r in ev.extract_events(df, (0.5,)).collect())
    assert got == want[:-1]  # the last event is still open
    left = st.open_events(spark, str(tmp_path / "state"), stream).collect()
    assert [(r["session"], r["modality"], r["thr"], r["t_start"], r["t_end"], r["peak"], r["n_hits"]) for r in left] == [(1, "v", 0.5, *want[-1], 0.9, 1)]
    # a new file continues from the checkpoint
    src.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(5000))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    st.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)
    # rows later than the watermark change nothing, closed or open
    src.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(2000))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    st.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)
    assert [r["t_start"] for r in st.open_events(spark, str(tmp_path / "state"), stream).collect()] == [5000.0]


def test_open_events_without_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = st.stream_events(spark.readStream.schema("session int, modality string, ts timestamp, p double").parquet(str(tmp_path / "in")))
    st.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert st.open_events(spark, str(tmp_path / "state"), stream).count() == 0


def test_a_drained_stream_and_its_state_are_the_batch(spark, tmp_path):
    """Closed and open events together, over several drains of random scores, are the batch operator's, without its source."""
    import random

    r = random.Random(3)
    rows = [(k % 3, "v", float(t), r.random()) for t in range(0, 600, 2) for k in range(3) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "session int, modality string, t double, p double")
    src = df.select("session", "modality", F.timestamp_micros((F.col("t") * 1e6).cast("bigint")).alias("ts"), "p", "t")
    (tmp_path / "in").mkdir()
    stream = st.stream_events(spark.readStream.schema(src.drop("t").schema).parquet(str(tmp_path / "in")), (0.5, 0.8), watermark="10 seconds")
    for lo in (0, 300):
        src.filter(F.col("t").between(lo, lo + 298)).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        st.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    for f in (tmp_path / "in").glob("*.parquet"):
        f.write_bytes(b"")  # nothing is left to read again
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).unionByName(st.open_events(spark, str(tmp_path / "state"), stream))
    columns = ["session", "modality", "thr", "t_start", "t_end", "peak", "n_hits"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, ev.extract_events(df, (0.5, 0.8)).select(*columns).collect()))


def test_catalogue_against_sql(spark):
    import __spark_entry__ as entry
    from chronoline.standins import TABLES
    from tools.check import compare

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for name in ("event_scores", "cover_join", "free_intervals", "classification_report", "pool_windows", "session_split", "time_features", "merge_records"):
        assert compare(queries[name](spark, sf).toPandas(), con.execute(sql[name]).df()).startswith("ok"), name
    assert entry.entry(spark).limit(1).count() == 1


def test_prediction_store_reads_whole_and_prunes_folders(spark, tmp_path):
    from chronoline.plans import load_catalog
    from chronoline.sources import stores
    from chronoline.standins import StandIns

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, StandIns(spark, sf).prediction.select("run_id", "clip", "y", "pred").collect()))
    got = load_catalog().QUERIES["prediction_store_runs"](spark, sf).select("run_id", "clip", "y", "pred").collect()
    assert sorted(map(tuple, got)) == want and len({r[0] for r in want}) == 5
    spark.range(10).selectExpr("id AS clip", "id % 5 AS run_id").write.partitionBy("run_id").parquet(str(tmp_path / "store"))
    kept = stores.read_predictions(spark, str(tmp_path / "store")).filter("run_id <= 2")
    assert kept.count() == 6 and "PartitionFilters: [isnotnull(run_id" in kept._jdf.queryExecution().toString()


def test_a_batch_run_twice_is_logged_once(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = lambda *ks: spark.createDataFrame([(k, f"v{k}") for k in ks], "session int, v string")
    assert stores.read_log(spark, log) is None
    for _ in range(2):
        stores.append_log(rows(1, 2, 2), log, batch=0)
    stores.append_log(rows(2, 3), log, batch=1)
    stores.append_log(rows(4), log)
    stores.append_log(rows(4), log)
    stores.append_log(rows(), log, batch=2)
    got = sorted((r["session"], r["v"]) for r in stores.read_log(spark, log).collect())
    assert got == [(1, "v1"), (2, "v2"), (3, "v3"), (4, "v4")]
    stores.append_log(rows(1, 2, 2), log, batch=0)  # a late retry
    assert stores.read_log(spark, log).count() == 4
    next((tmp_path / "log" / "batch=1").glob("_SUCCESS")).unlink()  # a batch that never ended
    assert stores.read_log(spark, log).count() == 3


def test_a_replayed_stream_logs_nothing_twice(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    spark.createDataFrame([(k % 5,) for k in range(20)], "session int").write.parquet(str(source))
    stream = lambda: spark.readStream.schema("session int").parquet(str(source))
    stores.log_stream(stream(), log, str(tmp_path / "s1"))
    spark.createDataFrame([(7,), (3,)], "session int").write.mode("append").parquet(str(source))
    stores.log_stream(stream(), log, str(tmp_path / "s1"))
    stores.log_stream(stream(), log, str(tmp_path / "s2"))
    assert sorted(r["session"] for r in stores.read_log(spark, log).collect()) == [0, 1, 2, 3, 4, 7]


def test_rows_of_a_split_sheet_keep_their_numbers(spark, tmp_path):
    lines = ["Event Label,Start,Note"] + [f"Stage {k % 5},2024-01-02 03:04:{k % 60:02d},{k}" for k in range(1, 3001)]
    lines[7] = "[unit],[s],7"
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(lines[:11]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = sheets.read_sheet(spark, str(tmp_path)).collect()
        assert spark.read.csv(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(rows) == 3010 and all(r["idx"] == int(r["Note"]) for r in rows)
    assert {r["reason"] for r in rows if r["idx"] == 7} == {"unit_row"}
