import numpy as np

from chronoline.llm import quality as Q


def test_held_out_accuracy(spark):
    from tests.llm.conftest import prose

    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        text = prose(k, 60) if good else (prose(k, 60).upper().replace(" ", "!! ") if k % 2 else f"{prose(k, 1)} " * 50)
        rows.append((k, text))
        labels.append((k, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, prose(1, 50)), (1002, prose(9, 20_000)), (1003, "zzz"), (1003, "zzz")]
    labels += [(2000, 1, 0), (1000, None, 0), (3, 1, 0), (3, 0, 0)]
    docs = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "doc_id long, text string, score double, x int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.held_out_quality(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 50 and np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    again = {r["doc_id"]: r["score"] for r in Q.held_out_quality(docs, marks).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in got)


def test_without_labels_and_empty(odd, none, spark):
    marks = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in Q.held_out_quality(odd, marks).collect()} == {0.5}
    assert Q.held_out_quality(none, marks).count() == 0


def test_shapes_tell_capitals_and_repeats():
    raw = np.frombuffer("Abc Xyz ABC abc abc ÉCÉ".encode(), np.uint8)
    forms, shapes, relations, begin = Q.streams(raw, np.array([0, len(raw)]))
    assert shapes[0] == shapes[1] and len({shapes[0], shapes[2], shapes[3]}) == 3 and shapes[2] == shapes[5]
    # letter case is not part of the form, so ABC and abc repeat each other
    assert forms[2] == forms[3] == forms[4] and relations.tolist() == [1, 1, 1, 0, 0, 1] and begin.tolist() == [0, 6]
