import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoline.operators import forest, ml


def test_a_tree_fits_its_rows_and_parts_stay_small():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 200, (3000, 6)).astype(np.uint8)
    y = rng.integers(0, 3, 3000)  # noise: a tree down to pure leaves repeats it
    tree = forest.grow(x, y, np.ones(3000), 3, 99, np.random.default_rng(2))
    assert (tree[4][forest.leaf(tree, x)].argmax(axis=1) == y).mean() > 0.999
    assert (np.bincount(forest.leaf(tree, x), minlength=len(tree[0]))[tree[0] < 0] > 0).all()
    for told in (y, np.zeros(3000, int)):  # also where nothing tells the classes
        top = forest.grow(x, told, np.ones(3000), 3, 30, np.random.default_rng(2), 100)
        sizes = np.bincount(forest.leaf(top, x), minlength=len(top[0]))[top[0] < 0]
        assert sizes.sum() == 3000 and sizes.max() <= 100


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, rng.normal(size=3)), "n") for k in range(1500)]
    rows = [(k, a, b if k % 11 else None, c, int(a > 0) + int(a > 1), t) for k, a, b, c, t in rows]
    return spark.createDataFrame([(*r, 7) for r in rows], "id int, a double, b double, c double, wlab int, probs string, _x0 int").repartition(4)


@pytest.mark.parametrize("part_rows", [100, 20_000])
def test_forest_in_parts(spark, windows, part_rows):
    train, test = windows.where("id < 1200"), windows.where("id >= 1200").drop("probs")
    fit = lambda tr, te: forest.random_forest(tr, te, 4, "wlab", ("a", "b", "c"), 30, 30, 42, part_rows)
    got = fit(train, test).collect()
    assert len(got) == 300 and set(got[0].asDict()) == {"id", "a", "b", "c", "wlab", "_x0", "probs"}
    assert sum(int(np.argmax(r["probs"])) == r["wlab"] for r in got) > 285
    assert all(len(r["probs"]) == 4 and r["probs"][3] == 0 and abs(sum(r["probs"]) - 1) < 1e-9 for r in got)
    again = fit(train.repartition(7), test.repartition(3)).collect()
    assert {r["id"]: r["probs"] for r in got} == {r["id"]: r["probs"] for r in again}  # whatever the partitions


def test_every_row_counts_and_copies_too(spark):
    # a rare class beyond any one part's reach of the first splits, and a row that 5,000 copies outvote
    rows = [(float(k % 250), 0) for k in range(5000)] + [(1000.0, 2)] * 3 + [(2000.0, 1)] * 5000 + [(2000.0, 0)]
    df = spark.createDataFrame(rows, "a double, wlab int")
    test = spark.createDataFrame([(3.0,), (1000.0,), (2000.0,)], "a double")
    got = {r["a"]: r["probs"] for r in ml.random_forest(df, test, 3, features=("a",), trees=40).collect()}
    assert got[3.0][0] == 1 and got[1000.0][2] > 0.8 and got[2000.0][1] > 0.9
    assert ml.random_forest(df.where("false"), test, 3, features=("a",), trees=3).where(F.col("probs").isNull()).count() == 3
    assert ml.random_forest(df, test.where("false"), 3, features=("a",), trees=3).count() == 0


def test_fitting_sends_no_trees_to_the_driver(spark, windows, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    def whole(*_):
        raise AssertionError("trees grown whole on the driver")

    monkeypatch.setattr(RandomForestClassifier, "_fit", whole)
    assert ml.random_forest(windows.drop("probs"), windows.drop("probs"), 4, features=("a", "b", "c"), trees=5).count() == 1500


def test_order_and_pieces():
    rng = np.random.default_rng(5)
    for many in (1, 300, 1 << 16, (1 << 16) + 1, 1 << 26):
        key = rng.integers(0, many, 5000)
        assert (forest._order(key, many) == np.argsort(key, kind="stable")).all()


def test_batches_are_dealt_together():
    """Pieces grow with parts times gathered batches, not times the small ones that Spark sends."""
    import pyarrow as pa

    small = [pa.RecordBatch.from_pydict({"x": list(range(k, k + 1000))}) for k in range(0, 200_000, 1000)]
    got = list(forest._gathered(iter(small)))
    assert len(got) <= 4 and [v for b in got for v in b.column(0).to_pylist()] == list(range(200_000))
    assert list(forest._gathered(iter([]))) == []


def test_a_task_grows_some_parts():
    assert [forest._tasks(n) for n in (1, 40, 100, 3200, 10**6)] == [1, 40, 64, 400, 4000]
