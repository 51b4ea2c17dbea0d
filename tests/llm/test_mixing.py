import re

import numpy as np

from chronoline.llm import mixing as M


def iterated(sizes, weights, factor, most):
    """The sharing rule step by step."""
    total, target = factor * sum(sizes), [0.0] * len(sizes)
    fixed = set()
    while True:
        left = total - sum(target[i] for i in fixed)
        free = [i for i in range(len(sizes)) if i not in fixed]
        w = sum(weights[i] for i in free)
        for i in free:
            target[i] = left * weights[i] / w
        over = [i for i in free if target[i] > most * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = float(most * sizes[i])
        fixed |= set(over)


def test_targets_equal_the_iterated_rule():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        sizes = [int(x) for x in rng.integers(0, 1000, n)]
        w = [(3, 1, 2)[i % 3] for i in range(n)]
        assert np.allclose(M.targets(sizes, w, 1.5, 2), iterated(sizes, w, 1.5, 2))


def test_tree_keeps_quotas_and_balances_shards():
    out = M.split_quotas([1000, 17, 0, 523], 7, 3)
    assert out.sum(axis=1).tolist() == [1000, 17, 0, 523] and (out >= 0).all()
    assert out.sum(axis=0).max() - out.sum(axis=0).min() <= 1
    assert (out == M.split_quotas([1000, 17, 0, 523], 7, 3)).all()


def test_mix(odd, odd_rows, none):
    got = M.mix(odd).collect()
    assert len(got) == len(odd_rows) and sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, (tuple(r) for r in M.mix(odd.repartition(2)).collect())))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for r in got:
        assert r["size"] == size(r["text"]) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["words"] for p in r["pieces"])
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 0.5
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = iterated([by[s][0]["source_size"] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2)
    assert np.allclose([by[s][0]["target"] for s in order], want)
    assert M.mix(none).count() == 0


def test_texts_have_the_taken_words(odd):
    mixed = M.mix(odd)
    want = sum(r["taken"] for r in mixed.collect())
    rows = M.mixed_texts(mixed).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows) == want
    assert all(0 <= r["shard"] < 64 for r in rows)


def test_prefix_levels(spark, monkeypatch):
    rows = [(k, "w " * (k % 7), "s" if k % 3 else "t") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = {r["doc_id"]: r["taken"] for r in M.mix(docs).collect()}
    monkeypatch.setattr(M, "LEAF_ROWS", 1)
    assert {r["doc_id"]: r["taken"] for r in M.mix(docs.where("doc_id < 3000")).collect()} == whole


def test_shards_hold_the_trees_quotas_in_local_order(spark, tmp_path):
    """The registered deal and the pipeline's files, shard by shard."""
    import __spark_entry__ as entry
    import corpus_pipeline as C

    rows = [(k, " ".join(f"w{k}x{j}" for j in range(1 + k * 7 % 23)), "en", "stu"[k % 5 % 3], 0) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    dealt = [r.asDict() for r in entry.queries()["op3_mixing_shards"](spark, str(tmp_path)).collect()]
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "stu"}
    words = [int(np.floor(t + 0.5)) for t in M.targets(list(sizes.values()), list(M.WEIGHTS), 1.5, 2)]
    width = max(1, -(-sum(words) // (64 * 256)))
    quotas = M.split_quotas([-(-w // width) for w in words], 64, 7)
    for k, s in enumerate(sizes):
        for shard in range(64):
            got = sum(r["words"] for r in dealt if r["source"] == s and r["shard"] == shard)
            assert abs(got - width * quotas[k, shard]) <= 23 + width, (s, shard)
    # the stage's files: one for each shard, its reads in the shard's order
    C.mixed(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).write.parquet(str(tmp_path / "mixed"))
    files = sorted((tmp_path / "mixed").glob("part-*"))
    assert len(files) == 64
    for shard, file in enumerate(files):
        want = sorted((r for r in dealt if r["shard"] == shard), key=lambda r: r["shard_order"])
        got = spark.read.parquet(str(file)).collect()
        assert [(r["doc_id"], len(r["text"].split())) for r in got] == [(r["doc_id"], r["words"]) for r in want]
