import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoline.llm import decontaminate as D
from chronoline.llm.terms import Sieve, Terms

TERM = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width):
    """(words, hits, items) of each text by trying every window at every place."""
    out = []
    for t in docs:
        w, hit, own = terms(t), set(), set()
        for ident, text in items:
            v = terms(text)
            for k in range(max(1, len(v) - width + 1) if v else 0):
                g = v[k : k + width]
                for i in range(len(w) - len(g) + 1):
                    if w[i : i + len(g)] == g:
                        hit.update(range(i, i + len(g)))
                        own.add("" if ident is None else str(ident))
        out.append((len(w), len(hit), tuple(sorted(own))))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    word = lambda: rng.choice(["Ana", "bo", "Ço", "d1", "漢字", "E", "ff"])
    prose = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    shared = prose(14)
    items = [(1, shared), (2, prose(12)), (2, prose(5)), (3, "bo"), (4, "Zz ff"), (5, ""), (6, None), (None, prose(11)), (7, shared), (8, shared + " tail end"), (9, "rare1 rare2 rare3 rare4")]
    texts = [None, "", " \n", "bo", "BO!bo", shared, shared.upper(), shared.lower().replace(" ", "  "), "zz FF zz", "x" * 70_000 + " bo " + "y" * 70_000, prose(400)]
    texts += [prose(20) + items[rng.randrange(3)][1] + prose(30) for _ in range(20)] + [shared * 40, "rare1 rare2 rare3", "rare1 rare2, rare3. Rare4"]
    return items, texts


@pytest.mark.parametrize("width,shingle", [(10, 3), (4, 2), (3, 3)])
def test_every_window_as_by_brute_force(spark, case, width, shingle):
    items, texts = case
    ids = [None if k == 3 else k % 25 for k in range(len(texts))]  # ids repeat, with other texts
    docs = spark.createDataFrame([(i, t, 1, "a", "b") for i, t in zip(ids, texts)], "doc_id long, text string, place int, key string, wid string").repartition(5)
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, keys int")
    got = D.judge(docs, bench, width=width, shingle=shingle).collect()
    want = [(i, *x) for i, x in zip(ids, brute(texts, items, width))]
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got))) == sorted(map(repr, want))
    assert sum(x[2] > 0 for x in want) > 20


def test_repeated_rows_and_empty_tables(spark, odd, none):
    bench = odd.select(F.col("doc_id").alias("item_id"), "text").where("doc_id in (1, 7, 12)")
    got = D.judge(odd, bench)
    assert got.count() == odd.count()
    assert {r["n_hit"] for r in got.where("doc_id in (7, 8)").collect()} == {2} and got.where("doc_id = 3").first()["items"] == ["1"]
    assert D.judge(none, bench).count() == 0
    assert D.judge(odd, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0


def test_a_common_passage_is_dealt_over_tasks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h i j k l").alias("text"))
    bench = spark.createDataFrame([(k, "a b c d e f g h i j") for k in range(50)], "item_id long, text string")
    every, found, owners = D.hits(docs, bench)
    assert found.count() == 3000 and owners.count() == 50 and every.count() == 3000
    assert D.judge(docs, bench).where("n_hit = 10 and size(items) = 50").count() == 3000


def test_terms_and_sieve(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 5000)
    table = spark.createDataFrame([(int(k),) for k in keys], "k long")
    sieve = Sieve(spark, table, "k")
    assert sieve.passes(keys).all() and sieve.passes(rng.integers(-(2**63), 2**63, 50_000)).mean() < 0.1
    raw = np.frombuffer("  Ab-é x\nAB".encode(), np.uint8)
    t = Terms(raw, np.array([0, 5, 5, len(raw)]))
    assert t.begin.tolist() == [0, 1, 1, 4] and t.hash[0] == t.hash[3] and len(set(t.hash.tolist())) == 3
    assert t.shingles(2)[1].tolist() == [1, 2]
    ends, data = t.slices(np.array([1, 2]), np.array([4, 2]))
    assert bytes(data[: ends[1]]).decode().split() == ["é", "x", "ab"] and ends.tolist()[1:] == [ends[1], ends[1]]
