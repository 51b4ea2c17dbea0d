from collections import Counter

from chronoline.llm import ngram_join as J
from chronoline.llm import shingles as S
from chronoline.llm.components import components


def brute(rows):
    words = [tuple((t or "").encode().lower().split()) for _, t in rows]
    texts = sorted(set(words))
    sets = {w: {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in texts}
    links, up = Counter(), {w: w for w in texts}

    def root(w):
        while up[w] != w:
            w = up[w]
        return w

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                up[root(b)] = root(a)
    least = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            least[root(w)] = min(i, least.get(root(w), i))
    copies = Counter(words)
    return sorted(((i, least.get(root(w)), links[w], copies[w]) for (i, _), w in zip(rows, words)), key=str)


def test_equals_brute_force(odd, odd_rows):
    got = J.near_duplicates(odd)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([(r[0], r[1]) for r in odd_rows])


def test_large_bands_and_blocks_lose_no_link(spark, monkeypatch):
    from tests.llm.conftest import prose

    base = prose(5, 100).split()
    rows = []
    for k in range(60):
        w = base.copy()
        w[(k * 7) % 100] = f"new{k}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "BLOCK", 16)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_keeps_one_of_each_group_with_all_columns(odd, odd_rows):
    kept = J.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 7, 9, 11, 12} <= set(ids) and not {2, 3, 5, 6, 8} & set(ids)
    assert ids.count(10) == 1 and len(ids) == len({r[1] for r in brute([(r[0], r[1]) for r in odd_rows]) if r[1] is not None}) + 1


def test_empty_table(none):
    assert J.near_duplicates(none).count() == 0 and J.keep_one(none).count() == 0


def test_posterior_cuts_keep_pairs_at_the_threshold():
    cuts = J.least_agreements()
    assert cuts == sorted(cuts) and len(cuts) == J.BANDS * J.ROWS // J.STEP
    assert cuts[-1] < 0.8 * J.BANDS * J.ROWS < J.BANDS * J.ROWS


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100}


def test_shingles_of_slices_equal_those_of_texts():
    import pyarrow as pa

    texts = ["a b c d e f g", "", "a b", None, "A  b\nc d e F g"]
    (first, last, raw, at), = S.slices(pa.array(texts))
    found, ends = S.shingle_hashes(raw, at)
    assert list(ends) == [0, 3, 3, 4, 4, 7]
    assert list(found[0:3]) == list(found[4:7])
