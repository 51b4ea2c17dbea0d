import hashlib

import pyarrow as pa

from chronoline.llm import digest as D


def edited(t, nxt):
    k = len(t) // 2
    return t[: len(t) - k] + nxt[:k]


def test_equals_brute_force(spark, monkeypatch):
    from tests.llm.conftest import prose

    rows = [(k * 3 % 101, prose(k, 5 + k)) for k in range(101)] + [(200, None), (201, ""), (203, "é漢😀ab"), (204, "x" * 150_000), (205, prose(1, 6))]
    rows[-1] = (205, rows[1][1])
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string").repartition(5)
    monkeypatch.setattr(D, "BLOCK_ROWS", 7)
    got = {r["doc_id"]: r for r in D.edited_fingerprints(docs).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    own = dict(zip((i for i, _ in order), D.to_hex(*D.digests(pa.array([t for _, t in order])))))
    for k, (i, t) in enumerate(order):
        j, nxt = order[(k + 1) % len(order)]
        e = edited(t, nxt)
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == own[i] and r["edited_fingerprint"] == D.to_hex(*D.digests(pa.array([e])))[0]
        assert r["near_next"] == D.likeness(D.from_hex([own[i]]), D.from_hex([own[j]]))[0]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert got[205]["fingerprint"] == own[order[[i for i, _ in order].index(rows[1][0])][0]]


def test_odd_rows(odd, odd_rows, none, spark):
    rows = D.edited_fingerprints(odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd_rows)
    assert D.edited_fingerprints(none).count() == 0
    one = D.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1
    assert D.fingerprints(odd).count() == len(odd_rows) and "text" not in D.fingerprints(odd).columns


def test_likeness_orders_edits():
    from tests.llm.conftest import prose

    base = prose(1, 400)
    near, half, far = base.replace("river", "rover", 3), edited(base, prose(2, 400)), "1234 5678 " * 200
    codes = D.digests(pa.array([base, base, near, half, far]))
    one = tuple(x[:1].repeat(5, axis=0) for x in codes)
    a, b, c, d, e = D.likeness(one, codes)
    assert a == b == 1 > c > d > e >= 0


def test_compare(spark):
    from pyspark.sql import functions as F

    rows = D.fingerprints(spark.createDataFrame([(1, "some words of a text"), (2, None)], "k long, text string"))
    got = rows.select("k", D.compare(F.col("fingerprint"), F.col("fingerprint")).alias("same"), D.compare(F.col("fingerprint"), F.lit(None).cast("string")).alias("none")).collect()
    assert all(r["same"] == 1 and r["none"] is None for r in got)
