"""Table-side modelling: tree baselines and batched window scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from chronoline.functions.numbers import argmax
from chronoline.operators import boosting, forest
from chronoline.operators.features import FEATURES
from chronoline.operators.splits import class_weights


def _weighted(train: DataFrame, n_classes: int, label: str) -> DataFrame:
    w = class_weights(train.withColumnRenamed(label, "y").select("y"), n_classes).withColumnRenamed("y", label)
    return train.join(w.withColumn(label, F.col(label).cast(train.schema[label].dataType)), label)


def random_forest(
    train: DataFrame, test: DataFrame, n_classes: int, label: str = "wlab", features: Sequence[str] = FEATURES, trees: int = 100,
    depth: int = 30, seed: int = 42,
) -> DataFrame:
    """Balanced random forest; adds ``probs`` to the test windows (M01). See ``forest.random_forest``."""
    return forest.random_forest(train, test, n_classes, label, features, trees, depth, seed)


def boosted_trees(
    train: DataFrame, test: DataFrame, n_classes: int, label: str = "wlab", features: Sequence[str] = FEATURES, rounds: int = 300,
    depth: int = 6, rate: float = 0.1, fit_rows: int | None = None,
) -> DataFrame:
    """Balanced gradient-boosted trees over all classes; adds ``probs`` and ``pred``.

    Fitted on all labelled rows unless ``fit_rows`` asks for fewer; see ``boosting.boosted_trees``.
    """
    scored = boosting.boosted_trees(_weighted(train, n_classes, label), test, n_classes, label, features, "weight", rounds, depth, rate, fit_rows)
    return scored.withColumn("pred", argmax(F.col("probs")).cast("int"))


def linear_scorer(weights: Sequence[float], bias: float = 0.0) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Default scorer: logistic of a weighted sum of the window's samples."""
    w = np.asarray(weights, dtype=np.float64)

    def make():
        return lambda batch: 1.0 / (1.0 + np.exp(-(np.asarray(batch, dtype=np.float64) @ w + bias)))

    return make


def score_windows(
    windows: DataFrame, make_scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, samples: str = "z", batch_size: int = 512,
) -> DataFrame:
    """Batched scoring with an injected model; adds ``p``."""
    score = predict_batch_udf(make_scorer, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[size]])
    return windows.withColumn("p", score(samples))
