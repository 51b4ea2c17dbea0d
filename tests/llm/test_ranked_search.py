import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chronoline.llm import ranked_search as R

TERM = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def terms(t):
    return Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))


def brute(docs, items, k):
    """Every item's best documents by scoring all of them."""
    held = [(i, c) for i, c in ((i, terms(t)) for i, t in docs) if c]
    total, words = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for ident, text in items:
        asked.setdefault(ident, Counter()).update(terms(text))
    out = []
    for ident, query in asked.items():
        scored = []
        for d, c in held:
            m = 100 - 75 + 75 * c.total() * total // words
            score = sum(r * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, r in query.items() if w in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(ident, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    words = [f"w{int(1.35 ** rng.uniform(0, 22))}" for _ in range(4000)]
    topic = [["Éclair", "ÉCLAIR", "Straße"], ["漢字", "x1", "x2", "x3"], ["deep", "sea", "vent"]]
    prose = lambda n, t: " ".join(rng.choice(topic[t]) if rng.random() < 0.1 else rng.choice(words) for _ in range(n))
    docs = [(k % 280, prose(rng.randint(1, 120), k % 3)) for k in range(300)]
    docs += [(1000 + k, "Deep sea VENT, w3") for k in range(40)] + [(None, "deep sea vent w3"), (None, None), (1, None), (2, ""), (3, " ,\n"), (5000, prose(30_000, 1))]
    items = [(k, prose(25, k % 3)) for k in range(12)] + [(20, "deep deep sea"), (20, "vent"), (21, None), (22, "nowhere-seen"), (None, "straße éclair"), (23, ""), (24, "w1"), (25, "vent w3 w3")]
    return docs, items


@pytest.mark.parametrize("k,shard,block,pack", [(10, 40, 4, 1 << 20), (3, 1000, 2, 60), (400, 60, 3, 1 << 20)])
def test_best_documents_as_by_brute_force(spark, case, monkeypatch, k, shard, block, pack):
    docs, items = case
    monkeypatch.setattr(R, "PACK", pack)
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, n int, term string").repartition(4)
    bench = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, query int")
    got = R.search(table, bench, k=k, shard=shard, block=block).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr) == brute(docs, items, k)


def test_empty_tables_and_other_id_types(spark, case):
    docs, items = case
    table = spark.createDataFrame([(str(i), t) for i, t in docs], "doc_id string, text string")
    bench = spark.createDataFrame([("a", "deep sea")], "item_id string, text string")
    assert R.search(table, bench, k=2).count() == 2
    assert R.search(table.where("false"), bench).count() == 0 and R.search(table, bench.where("false")).count() == 0
    assert R.search(table, bench).dtypes == R.search(table.where("false"), bench).dtypes


def test_blocks_are_skipped_by_bounds_and_gather_alike_documents(spark):
    rng = np.random.default_rng(2)
    n, topics = 600, 6
    sizes = np.full(n, 6)
    term = np.concatenate([np.sort(np.concatenate([[0], 1 + 8 * (d % topics) + rng.permutation(8)[:5]])) for d in range(n)])  # term 0 is in every document
    start = np.concatenate([[0], np.cumsum(sizes)])
    gain = rng.integers(100, 1000, len(term))
    pack = R.Pack([{"item": q, "term": f"{t:03}", "repeats": 1} for q in range(topics) for t in [0, *range(1 + 8 * q, 9 + 8 * q)]])
    pack.weight = np.full(len(pack.term), 10)
    pack.need(np.zeros(topics, np.int64), np.full(len(pack.terms), 1000))
    parts = {"start": start, "term": term, "gain": gain} | R.blocked(start, term, gain, pack, 10)
    for b in range(len(parts["member_start"]) - 1):  # maxima are those of the members
        own = parts["member"][parts["member_start"][b] : parts["member_start"][b + 1]]
        for t, g in zip(parts["max_term"][parts["max_start"][b] : parts["max_start"][b + 1]], parts["max_gain"][parts["max_start"][b] : parts["max_start"][b + 1]]):
            assert g == max(gain[start[d] : start[d + 1]][term[start[d] : start[d + 1]] == t].max(initial=0) for d in own)
    every = parts["list_start"]
    blocks = range(every[0], every[1])  # of term 0: one topic each
    assert np.mean([len({int(d) % topics for d in parts["member"][parts["member_start"][b] : parts["member_start"][b + 1]]}) == 1 for b in blocks]) > 0.9
    weight = np.zeros(len(pack.terms), np.int64)
    for q in range(topics):
        rows, scores, scored = R.walk(parts, np.arange(n), pack, q, 5, weight)
        own, w = pack.query(q)
        whole = np.zeros(len(pack.terms), np.int64)
        whole[own] = w
        want = R.products(start, term, gain, np.arange(n), whole)
        assert scores.tolist() == np.sort(want)[::-1][:5].tolist() and scored < n / 2
        pack.least[q] = scores[-1]
    assert not weight.any()


def test_long_texts_are_split_between_terms(monkeypatch):
    text = "aB1 ééé;" * 50 + "z" * 300 + " end"
    whole = R.count_terms(text)
    for piece in (1, 7, 100):
        monkeypatch.setattr(R, "PIECE", piece)
        assert R.count_terms(text) == whole
    assert whole[b"ab1"] == 50 and whole["ééé".encode()] == 50 and whole[b"z" * 300] == 1


def test_gains_beyond_64_bits():
    n, tf = np.array([3, 2_000_000_000_000]), np.array([2, 5])
    got = R.gains(n, tf, np.array([1, 1]), 10**9, 10**12)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * int(x) * 10**9 // 10**12)) for x, t in zip(n, tf)]
