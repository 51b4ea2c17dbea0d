"""The broad ranking beside its SQL, where Java's word borders and a rounding of rounded scores would differ."""

import duckdb
from pyspark.sql import functions as F

from chronoline.functions import text as tx
from chronoline.plans import load_catalog

TEXTS = ["un modèle", "modèle là", "là éla", "le soleil", "thé and tea", "the end", "éthe", "le_un", "dés des", "ünd and", "la", None, "", "the editorial and"]
#: Citations whose scores change in the sixth digit if they are rounded to nine before.
CITED = (879, 936, 2434, 2541)


def test_word_borders_are_ascii(spark):
    assert tx.ascii_edges(r"a\\b\.") == r"a\\b\." and tx.ascii_edges(r"\\\b") == r"\\" + tx.WORD_EDGE
    patterns = (r"\ble\b", r"\bla\b", r"\bthe\b", r"\bth", r"le\b", "the", r"\b(?:la|le)\b", "th.?a", r"\d")
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", *(tx.hits(F.col("t"), [p]).alias(p) for p in patterns)).collect()
    for r in got:
        for p in patterns:
            assert r[p] == duckdb.execute("SELECT regexp_matches($1, $2)::INT", [r["t"], p]).fetchone()[0], (r["t"], p)


def test_top_per_topic_equals_its_sql(spark, tmp_path):
    rows = [(k, TEXTS[k % len(TEXTS)], k * 100 // 14) for k in range(4 * len(TEXTS))] + [(10_000 + 20 * c, "the thing", c) for c in CITED]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({"lang": F.lit("en"), "source": F.lit("a")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    catalog = load_catalog()
    got = catalog.QUERIES["top_per_topic"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.SQL["top_per_topic"]).fetchall()
    key = lambda r: (r[1], r[3])
    assert sorted((tuple(r[c] for c in ("doc_id", "topic", "score", "place")) for r in got), key=key) == sorted(want, key=key)
    assert len(want) > 28
