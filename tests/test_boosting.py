import numpy as np
import pytest

from chronoline.operators import boosting as B, ml


def grown_by_hand(x, g, h, depth, rate):
    """Exact greedy trees over all cuts between distinct values, by recursion."""

    def node(rows, level):
        value = -rate * g[rows].sum() / (h[rows].sum() + B.PENALTY)
        best = None
        for f in range(x.shape[1]) if level < depth else ():
            for c in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if min(h[left].sum(), h[right].sum()) < B.LEAST_WEIGHT:
                    continue
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + B.PENALTY)
                gain = score(left) + score(right) - score(rows)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, left, right)
        if best is None:
            return {int(r): value for r in rows}
        return node(best[1], level + 1) | node(best[2], level + 1)

    return node(np.arange(len(x)), 0)


def test_trees_equal_exact_greedy_growth():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (80, 3)).astype(float)
    g, h = rng.normal(size=80), rng.uniform(0.5, 1.5, 80)
    binned, cuts = B._binned(x, 256)
    feature, at, value, leaf = B.grow(binned, max(len(c) + 1 for c in cuts), g, h, 3, 0.1)
    want = grown_by_hand(x, g, h, 3, 0.1)
    assert np.allclose(value[leaf], [want[k] for k in range(80)])


def test_classes_are_told_and_probabilities_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    x[::17, 3] = np.nan
    y = (x[:, 0] > 0) + 2 * (x[:, 1] > 0.5)
    y = np.where(y == 3, 4, y)  # class 3 is not seen
    m = B.fit(x[:400], y[:400], np.ones(400), 60, 4, 0.2)
    p = m.probabilities(x[400:], 5)
    assert np.allclose(p.sum(axis=1), 1) and (p[:, 3] == 0).all() and (p.argmax(axis=1) == y[400:]).mean() > 0.95
    assert np.array_equal(m.margins(x[:7]), m.margins(x[:7]))


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, rng.normal(size=2)), "n") for k in range(300)]
    rows = [(k, a, b if k % 11 else None, int(a > 0) + int(a > 1), c) for k, a, b, c in rows]
    return spark.createDataFrame([(*r, 7) for r in rows], "id int, a double, b double, wlab int, probs string, _x0 int").repartition(4)


def test_rows_columns_and_bounds(spark, windows):
    train, test = windows.where("id < 200"), windows.where("id >= 200").drop("probs")
    fit = lambda tr, te, **k: ml.boosted_trees(tr, te, 4, features=("a", "b"), rounds=20, depth=3, **k)
    got = fit(train, test).collect()
    assert len(got) == 100 and set(got[0].asDict()) == {"id", "a", "b", "wlab", "_x0", "probs", "pred"}
    assert sum(r["pred"] == r["wlab"] for r in got) > 90 and all(len(r["probs"]) == 4 and r["probs"][3] == 0 for r in got)
    again = fit(train.repartition(7), test).collect()
    assert {r["id"]: r["probs"] for r in got} == {r["id"]: r["probs"] for r in again}  # whatever the partitions
    few = fit(train, test, fit_rows=3).collect()
    assert len(few) == 100 and len({tuple(r["probs"]) for r in few}) <= 2
    assert fit(train, test.where("false")).count() == 0
    assert {r["pred"] for r in fit(train.where("false"), test).collect()} == {None}
    assert {r["pred"] for r in fit(train.where("wlab = 1"), test).collect()} == {1}


def test_the_scale_of_weights_does_not_matter(spark):
    rng = np.random.default_rng(6)
    rows = [(k, *map(float, rng.normal(size=2))) for k in range(400)]
    df = spark.createDataFrame([(k, a, b, int(a > 0), 1e-4) for k, a, b in rows], "id int, a double, b double, y int, w double")
    got = B.boosted_trees(df.where("id < 300"), df.where("id >= 300"), 5, "y", ("a", "b"), "w", 20, 3, 0.3).collect()
    assert sum((r["probs"][1] > 0.5) == (r["y"] == 1) for r in got) > 90
