import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chronoline.llm import kneser_ney as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [(i, WORD.findall((t or "").translate(fold)) + ["\0"]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in toks]
    uni, bi = Counter(), Counter()
    for (_, t), h in zip(toks, held):
        if not h:
            uni.update(t)
            bi.update(zip(["\0", *t[:-1]], t))
    n, v, cont = sum(uni.values()), len(uni), Counter(w for _, w in bi)

    def discounts(values):
        c = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] and c[1] else None
        return [0.0] + [min(k, max(0.0, k - (k + 1) * y * c[k] / c[k - 1])) if y is not None and c[k - 1] and c[k] else k / 2 for k in (1, 2, 3)]

    db, dw = discounts(bi.values()), discounts(cont.values())
    rest = sum(dw[min(c, 3)] for c in cont.values()) / len(bi) if bi else 1.0
    left = Counter()
    for (h, _), c in bi.items():
        left[h] += db[min(c, 3)]

    def p(h, w):
        low = (max(0, cont[w] - dw[min(cont[w], 3)]) / len(bi) if bi else 0) + rest / (v + 1)
        return (max(0, bi[h, w] - db[min(bi[h, w], 3)]) + left[h] * low) / uni[h] if uni[h] else low

    if uni:  # the words and one unknown one
        assert math.isclose(sum(p("\0", w) for w in [*uni, "unseen word"]), 1)
    return sorted((str(i), h, len(t), sum(uni[w] > 0 for w in t), n, round(sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6), round(sum(math.log10(p(a, b)) for a, b in zip(["\0", *t[:-1]], t)), 6)) for (i, t), h in zip(toks, held))


def rows_of(df):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect())


def test_equals_brute_force(odd, odd_rows):
    got, want = rows_of(K.held_out_scores(odd)), brute([(r[0], r[1]) for r in odd_rows])
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_many_parts_and_slices(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(K, "PART_TOKENS", 500)
    monkeypatch.setattr(K, "HELD", 100)
    got, want = rows_of(K.held_out_scores(odd)), brute([(r[0], r[1]) for r in odd_rows])
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_empty_table(none, odd):
    assert K.held_out_scores(none).count() == 0
    assert all(r["score"] == r["base_score"] == 0 for r in K.score(odd.select("doc_id", "text"), K.train(none)).collect())


def test_counts_beyond_32_bits_are_an_error():
    assert K.narrow(np.array([0, 2**32 - 1])).tolist() == [0, 2**32 - 1] and not len(K.narrow(np.zeros(0, np.int64)))
    with pytest.raises(ValueError, match="wider"):
        K.narrow(np.array([1, 2**32]))
