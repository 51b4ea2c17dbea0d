import re

import corpus_pipeline as C
from chronoline.llm import pieces
from tests.llm.test_ngram_join import brute
from tests.llm.test_pii import brute as base


def test_stages_equal_brute_force(spark, odd, odd_rows, tmp_path):
    """Each stage on what the one before it kept."""
    rows = [r for r in odd_rows if r[0] != 12] + [(300, "mail me a.b@example.com or +1 (555) 555-1234 today and then the words go on", "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    results = []
    for name, stage in C.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        results.append(docs.collect())
    known, one, clean, mixed, coded = results
    for r in results[:-1]:
        assert tuple(r[0].__fields__) == C.COLUMNS

    # language: what has words of a language stays
    assert sorted(str(r["doc_id"]) for r in known) == sorted(str(r[0]) for r in rows if re.search("[A-Za-z]{2}", r[1] or ""))
    # near duplicates: one of each group, the smallest id
    groups = brute([(r["doc_id"], r["text"]) for r in known])
    ids = [r["doc_id"] for r in one]
    assert sorted(i for i in ids if i is not None) == sorted({g[1] for g in groups if g[1] is not None}) and len(ids) == len(set(ids))
    # personal data: gone, the rest as before
    before = {r["doc_id"]: r["text"] for r in one}
    for r in clean:
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["doc_id"] == 300 or r["text"] == before[r["doc_id"]]
    assert next(r for r in clean if r["doc_id"] == 300)["text"].startswith("mail me <EMAIL> or <PHONE> today")
    # mixing: every read is the text or its beginning, at most two reads
    texts = {r["doc_id"]: r["text"] for r in clean}
    for i in texts:
        reads = [r["text"] for r in mixed if r["doc_id"] == i]
        assert len(reads) <= 2 and all(texts[i].startswith(t) for t in reads)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert abs(sum(size(r["text"]) for r in mixed) - 1.5 * sum(map(size, texts.values()))) <= 3
    # pieces: one row a read, ids that decode to it
    model = pieces.Pieces(pieces.read_model())
    assert len(coded) == len(mixed) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in coded)
    import numpy as np

    assert sorted(model.decode(np.array(r["ids"], np.int32)) for r in coded) == sorted(r["text"] for r in mixed)


def test_run_on_an_empty_table(spark, none, tmp_path):
    none.select(*C.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stages_send_small_batches(spark, odd, monkeypatch):
    monkeypatch.setattr(C.language, "keep_identified", lambda docs: docs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    try:
        C.identified(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), "")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == C.BATCH_ROWS
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_workers_give_back_what_arrow_holds(monkeypatch):
    """After each batch, by the pool's own call: idle workers of all stages would keep it beside the next stage's."""
    from types import SimpleNamespace

    import pyarrow as pa

    from chronoline.llm.common import lean

    given = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: given.append(1)))
    batches = [pa.RecordBatch.from_pydict({"text": [str(k)]}) for k in range(3)]
    assert list(lean(iter(batches))) == batches and len(given) == 3
    assert C.BATCH_ROWS <= 500
