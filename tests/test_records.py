"""Text folding, keys, rankings and small conventions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoline.functions import numbers, text as tx
from chronoline.operators import records as rc, splits, timeline
from chronoline.sources import sheets, stores


def test_fold_and_keys(spark):
    names = ["Šimić", "Öğüş", "Łódź", "ﬁne", "Ěa", "中"]
    got = [r["f"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(tx.ascii_fold(F.col("n")).alias("f")).collect()]
    assert got == ["Simic", "Ogus", "odz", "fine", "Ea", ""]
    rows = spark.createDataFrame([("Ana Šimić", 2020, "The Rapid <b>Test</b>"), (None, 2021, "With")], "a string, y int, t string")
    assert [r["k"] for r in rows.select(tx.citation_stem(F.col("a"), F.col("y"), F.col("t")).alias("k")).collect()] == ["simic2020rapid", "anon2021x"]


def test_bare_numbers_count_at_the_archive_only(spark):
    rows = spark.createDataFrame([(["http://x/2101.00001", "http://y/2202.00002"], ["Journal", "arXiv (Cornell)"])], "u array<string>, n array<string>")
    assert rows.select(tx.arxiv_id(F.col("u"), names=F.col("n")).alias("x")).first()["x"] == "2202.00002"
    assert rows.select(tx.arxiv_id(F.col("u")).alias("x")).first()["x"] == ""


def test_rankings_look_where_they_should(spark):
    rows = [(1, "a seizure paper", "an editorial on mice", None, 0), (2, "a seizure supplementary file", "mice", None, 100), (3, "seizure issue", "mice", "paratext", 100), (4, "mouse", "no", None, 5)]
    df = spark.createDataFrame(rows, "i long, t string, a string, k string, c int").withColumn("x", F.concat_ws(" ", "t", "a"))
    topic = {"m": rc.Topic(groups=(("title", ("seizure",)),), any_of=(rc.Topic(("mice",)), rc.Topic(("rats",))))}
    got = rc.top_per_topic(df, topic, 9, "i", F.col("t"), F.col("x"), F.col("c"), "shortlist", kind=F.col("k")).orderBy("place").collect()
    assert [r["i"] for r in got] == [1, 2, 3] and got[1]["score"] < 0
    broad = rc.top_per_topic(df, {"m": rc.Topic(("mice",))}, 9, "i", F.col("t"), F.col("x"), F.col("c"), "broad").collect()
    assert {r["i"] for r in broad} == {2, 3}


def test_even_widths_and_cut_indices(spark):
    trace = spark.createDataFrame([("s", "v", float(k), float(k * k % 7)) for k in range(12)], "session string, modality string, t double, p double")
    for k in (4, 5):
        got = [r["smooth"] for r in timeline.moving_average(trace, k, chunk=5).orderBy("t").collect()]
        assert np.allclose(got, np.convolve([j * j % 7 for j in range(12)], np.ones(k) / k, "same"))
    cut = spark.range(1).select(numbers.sample_indices(F.lit(11), 4, truncate=True).alias("i")).first()["i"]
    assert cut == np.linspace(0, 10, 4).astype(int).tolist()


def test_split_without_a_seed_is_an_error(spark):
    clips = spark.createDataFrame([(1, 0), (2, 1)], "session long, y int")
    with pytest.raises(ValueError):
        splits.session_split(clips, n_classes=2, max_tries=3)


def test_clock_without_day(spark):
    sheet = spark.createDataFrame([("08:30:00", "x"), ("[s]", "y"), (None, "z"), ("2024-01-02 08:30:00", "w")], "Start string, Label string")
    assert [r["reason"] for r in sheets.normalise_sheet(sheet).collect()] == ["no_day", "unit_row", "no_start", "ok"]


def test_manifest_depth(spark, tmp_path):
    for p in ("a.txt", "x/b.txt", "x/y/c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1")
    names = lambda d: {r["path"].rsplit("/", 1)[1] for r in stores.read_manifest(spark, str(tmp_path), depth=d).collect()}
    assert names(0) == {"a.txt"} and names(1) == {"a.txt", "b.txt"} and names(None) == {"a.txt", "b.txt", "c.txt"}


def test_source_by_name_and_subject(spark):
    archive = spark.createDataFrame([(1, "/r/RN1/d/f.edf", 0), (0, "/r/RN2/d/f.edf", 0), (1, "/r/2024/f.edf", 1)], "root_ord int, path string, layout int")
    wanted = spark.createDataFrame([("f.edf", "RN1"), ("f.edf", "RN2"), ("f.edf", "RN3"), ("g.edf", "RN1")], "name string, subject string")
    got = {(r["name"], r["subject"]): r["source_path"] for r in stores.find_source(wanted, archive).collect()}
    assert got == {("f.edf", "RN1"): "/r/RN1/d/f.edf", ("f.edf", "RN2"): "/r/RN2/d/f.edf", ("f.edf", "RN3"): "/r/2024/f.edf", ("g.edf", "RN1"): None}


def test_merged_ids_and_queries(spark):
    t = "A long enough title here"
    rows = [(1, t, "x", "x1", "q1", 3), (2, t.upper(), "x", "x2", "q2", 9), (3, t + "!", "y", "y1", "q1", 1), (4, "short", "x", "x3", "q3", 0), (5, "Another long enough title", "z", None, "q4", 0)]
    df = spark.createDataFrame(rows, "ord int, title string, source_api string, record_id string, source_query string, cited_by_count int").repartition(3)
    got = {r["ord"]: (r["sources"], r["record_ids"], r["cited_by_count"]) for r in rc.merge_records(df, "ord", ident="record_id").collect()}
    assert got == {1: ("x+y", "x1 | y1", 9), 5: ("z", "", 0)}
    assert sorted((r["ord"], r["source_query"]) for r in rc.also_queries(df, "ord").collect()) == [(2, "q2"), (3, "q1")]


def test_session_inputs(spark):
    from chronoline.operators import timeline

    rec = spark.createDataFrame([(1, 100.0, True), (1, 50.0, False), (2, 10.0, True), (3, 5.0, False)], "session int, t_start double, has_sidecar boolean")
    ann = spark.createDataFrame([(1, "Stage 1", 500.0), (1, "Spikes", 120.0), (2, "Stage 2", 5.0)], "session int, label string, t_start double")
    sig = spark.createDataFrame([(1, "a.edf", 0.0, 400.0), (1, "b.edf", 85.0, 900.0), (2, "d.edf", 7.0, 9.0), (2, "c.edf", 6.0, 9.0)], "session int, path string, t_start double, t_end double")
    got = {r["session"]: tuple(r)[1:] for r in timeline.session_inputs(rec, ann, sig).collect()}
    assert got == {1: (1, 1, 2, "b.edf", True, 15.0, True), 2: (1, 0, 2, "c.edf", False, 4.0, False), 3: (0, 1, 0, None, False, None, None)}


def test_titles_are_keyed_once(spark):
    df = spark.createDataFrame([(k, f"the same long title {k % 3}", f"q{k}") for k in range(9)], "ord int, title string, source_query string")
    out = rc.also_queries(df, "ord")
    assert out.count() == 6 and "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
