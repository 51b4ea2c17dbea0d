import random
import re
import zlib

import numpy as np
import pytest

from chronoline.llm import spelling as S


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(counts, factor=10):
    out = {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= factor * n else None
        out[w] = [form, n, len(around), counts.get(form)]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(3)
    words = {"": 3, "a": 40, "b": 2, "ab": 7, "aaaaaaa": 5000, "aaaaaa": 40, "aaaaaaaa": 400, "漢字漢字漢字": 50, "漢字漢字漢": 5, "x" * 5000: 90, "x" * 4999: 3, "x" * 2500 + "y" + "x" * 2499: 2}
    for _ in range(700):  # few letters: dense groups that must be cut down to the alphabet
        words["".join(rng.choice("abç") for _ in range(rng.randint(5, 9)))] = rng.choice([2, 3, 20, 30, 250, 4000])
    return words


@pytest.mark.parametrize("tile", [2, 40, 100_000])
def test_groups_as_by_brute_force(spark, counts, tile):
    rows = [(w, n, 1, "z") for w, n in counts.items()] + [(None, 9, 1, "z"), ("once", 1, 1, "z")]
    table = spark.createDataFrame(rows, "word string, n long, long int, head string").repartition(3)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in S.group_variants(table, tile=tile).collect()}
    want = brute(counts)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[0] != v[1] for v in want.values() if v[0])


def test_repeated_words_add_up_and_empty_tables(spark):
    table = spark.createDataFrame([("letters", 1), ("letters", 1), ("lettres", 1), ("letter", 30)], "word string, n long")
    got = {r["word"]: r["form"] for r in S.group_variants(table).collect()}
    assert got == {"letters": "letter", "letter": None}
    assert S.group_variants(table.where("false")).count() == 0


def test_tiles_find_each_pair_once():
    rng = np.random.default_rng(0)
    words = sorted({"".join(rng.choice(list("ab"), 6)) for _ in range(60)} | {"".join(rng.choice(list("ab"), 5)) for _ in range(30)})
    group = np.zeros(len(words), np.int64)
    i, j = S.near_pairs(words, group, np.full(len(words), 7), 6)
    want = {(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if max(len(words[a]), len(words[b])) == 6 and near(words[a], words[b])}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def test_runs_of_whole_texts(spark, odd):
    found = re.compile("[A-Za-zÀ-ÿ]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(5, "ÉÈ×÷Àblü Straßeß a-bcdefgh ŁódźŁódź xÿÿÿÿÿÿ " * 50), (None, "Ordinary ordinary")]
    want = {}
    for ident, t in rows:
        for w in map(lower, found.findall(t or "")):
            h = zlib.crc32(f"{'' if ident is None else ident}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w
            if len(w) >= 7:
                want[w] = want.get(w, 0) + 1
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["word"]: r["n"] for r in S.runs(table, drop=3).collect()} == want
    assert S.runs(table.where("false")).count() == 0
