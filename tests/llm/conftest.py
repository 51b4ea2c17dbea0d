import random

import pytest

WORDS = "the of and to in that was with from here there under over stone river cloud green light paper table window garden".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.choice("abcdefghij")) * rng.randint(0, 2) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls, empty, short and very long texts, ties, repeats and near copies."""
    base = prose(1, 120).split()
    near = base.copy()
    near[60] = "changed"
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(near), "en", "a"), (3, " ".join(base).upper(), "en", "b"), (4, None, "en", "a"), (5, "", "en", None),
        (6, " \t\n", None, "b"), (7, "one two", "en", "c"), (8, "one two", "de", "c"), (9, prose(2, 30_000), "en", "a"), (None, prose(3, 80), "en", "b"),
        (None, None, None, None), (10, prose(4, 90), "en", "c"), (10, prose(4, 90), "en", "c"), (11, "x" * 100_000, "en", "a"), (12, "漢字 é ü\nnew line  two", "fr", "ü"),
    ]
    return rows + [(100 + k, prose(100 + k, 60 + k), "en", "abc"[k % 3]) for k in range(25)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows above with columns whose names the operators use themselves."""
    rows = [(*r, len(r[1] or ""), "x", "y", 7, "z") for r in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, _node string, taken int, ids string").repartition(4)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
