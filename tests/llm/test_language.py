from pyspark.sql import functions as F

from chronoline.llm import language as L

EN, DE = "the house and the garden were there with them ", "der Garten und das Haus waren nicht für die Kinder "


def test_documents(spark, odd, odd_rows, none):
    rows = [(k, (EN, DE)[k % 2] * 3, ("en", "de")[k % 2], f"s{k % 2}") for k in range(20)]
    rows += [(20, DE * 4, "en", "s0"), (21, "12 34", "en", "s0"), (22, None, "en", None), (23, "", None, "s1"), (24, EN * 2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    languages, model = L.trigram_model(docs, "text", "lang")
    got = {r["doc_id"]: r for r in L.identify_documents(docs, languages, model).collect()}
    assert len(got) == 25
    assert all(got[k]["predicted"] == ("en", "de")[k % 2] for k in range(20))
    assert got[24]["predicted"] == "en"
    assert all(got[k]["rejected"] and got[k]["predicted"] is None for k in (21, 22, 23))
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k in got if not got[k]["rejected"]}
    kept = L.keep_identified(odd)
    assert kept.columns == odd.columns and {1, 2, 3, 9, 10} <= {r["doc_id"] for r in kept.collect()}
    assert L.keep_identified(none).count() == 0


def test_evidence_decides_where_the_text_does_not(spark):
    # "alarm" is as likely in either language; the host speaks German
    rows = [(k, f"http://h{k % 2}.example.com/{('en', 'de')[k % 2]}/{k}", f"<html lang='{('en', 'de')[k % 2]}'><body>{(EN, DE)[k % 2] * 3}</body></html>") for k in range(200)]
    rows += [(1000, "http://h1.example.com/x", "<html><body>alarm</body></html>"), (1001, "http://h0.example.com/x", "<html><body>alarm</body></html>"), (1002, None, None), (1003, "no address", "<p>12</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = spark.createDataFrame([(EN + "alarm", "en"), (DE + "alarm", "de")] * 4, "text string, lang string")
    languages, model = L.trigram_model(known, "text", "lang")
    got = {r["page_id"]: r for r in L.identify_pages(pages, languages, model).collect()}
    assert got[1000]["predicted"] == "de" and got[1001]["predicted"] == "en"
    assert got[1002]["rejected"] and got[1003]["rejected"] and len(got) == 204


def test_markup(spark):
    page = "<HTML class='x' LANG = 'pt-BR'><script>var a='<p>';</script><!-- <b>no</b> --><p>yes</p>"
    rows = spark.createDataFrame([(page, "https://a.B.co.uk/fr/x")], "h string, u string")
    got = rows.select(L.visible_text(F.col("h")).alias("t"), L.markup_language(F.col("h")).alias("m"), L.address_suffix(F.col("u")).alias("s")).first()
    assert got["t"].split() == ["yes"] and got["m"] == "pt" and got["s"] == "uk/fr"
