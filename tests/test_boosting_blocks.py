"""Boosted trees over more rows than one task fits."""

import numpy as np
from pyspark.sql import functions as F

from chronoline.operators import boosting as B, ml


def table(spark, n, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[::19, 2] = np.nan
    x[:, 1] = np.round(x[:, 1], 1)  # few values
    y = (x[:, 0] > 0) + 2 * (x[:, 1] > 0.5) + (rng.random(n) < 0.1)
    return x, y, spark.createDataFrame([(*map(float, r), int(c), float(1 + c)) for r, c in zip(x, y)], "x0 double, x1 double, x2 double, y long, w double")


def test_blocks_grow_the_trees_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 700)
    monkeypatch.setattr(B, "WRITE_EVERY", 3)
    x, y, df = table(spark, 3000)
    for have, want in zip(B._cuts(df, ("x0", "x1", "x2"), 3000, 256), B._binned(x, 256)[1]):
        assert np.allclose(have, want, rtol=0, atol=1e-12)
    w = (1.0 + y) / (1.0 + y).mean()
    one = B.fit(x, y, w, 8, 4, 0.3)
    got = B.fit_blocks(df, 3, 3000, 8, 4, 0.3)
    assert np.array_equal(got.classes, one.classes) and np.allclose(got.margins(x), one.margins(x), atol=1e-6)
    monkeypatch.setattr(B, "DIRECT", 2)
    again = B.fit_blocks(df.repartition(3), 3, 3000, 8, 4, 0.3)
    assert all(np.array_equal(getattr(got, c), getattr(again, c)) for c in ("feature", "cut", "value"))  # whatever the partitions


def test_rows_beyond_one_task_are_learned_from(spark, monkeypatch):
    """A few rows of a rare class and all others count: the model is not one of 1,000 rows."""
    monkeypatch.setattr(B, "TASK_ROWS", 1000)
    monkeypatch.setattr(B, "BLOCK_ROWS", 1000, raising=False)
    seen = []
    monkeypatch.setattr(B, "fit_blocks", lambda rows, many, n, *a, f=getattr(B, "fit_blocks", None): seen.append((n, rows.count())) or f(rows, many, n, *a), raising=False)
    df = spark.range(4000).select("id", (F.col("id") % 100).cast("double").alias("a"), F.when(F.col("id") % 400 == 7, 3).otherwise((F.col("id") % 100 >= 50).cast("int")).alias("wlab"))
    df = df.withColumn("a", F.when(F.col("wlab") == 3, F.lit(7.25)).otherwise(F.col("a")))
    got = ml.boosted_trees(df, df, 5, features=("a",), rounds=6, depth=3, rate=0.3).collect()
    assert seen == [(4000, 4000)] and len(got) == 4000 and all(r["pred"] == r["wlab"] for r in got)
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 and r["probs"][2] == r["probs"][4] == 0 for r in got)
