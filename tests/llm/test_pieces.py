import random

import sentencepiece

from chronoline.llm import pieces as P


def test_ids_equal_the_library():
    proto = P.read_model()
    own, lib = P.Pieces(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    rng = random.Random(4)
    texts = ["".join(rng.choice("aabe  tnh\n\tThe漢é😀\x00▁.<0x>") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "   ", " a", "a ", "<s> </s> <0x0A>", "a" * 3000, "ab" * 2000, "The quick brown fox  jumps\nover"]
    got = own.encode(texts)
    assert [g.tolist() for g in got] == lib.encode(texts)
    assert [own.decode(g) for g in got] == [lib.decode(g.tolist()) for g in got]
    assert [own.decode(g) for g in got] == [t.replace("▁", " ") for t in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "WORDS_KEPT", 10)
    own = P.Pieces(P.read_model())
    texts = [f"word{k} and{k}" for k in range(40)]
    first = [own.encode([t])[0].tolist() for t in texts]
    assert first == [g.tolist() for g in own.encode(texts)] and len(own.older) <= 100


def test_tables(odd, odd_rows, none):
    model = P.read_model()
    coded = P.decode(P.encode(odd, model), model)
    assert coded.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "ids"]
    rows = coded.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r["decoded"] == r["text"]
        assert (r["ids"] is None) == (r["text"] is None) and (r["text"] != "" or r["ids"] == [])
    assert P.decode(P.encode(none, model), model).count() == 0
    checked = P.encode_and_check(odd, model).collect()
    assert all(r["round_trip"] for r in checked) and sorted((str(r["doc_id"]), str(r["ids"])) for r in checked) == sorted((str(r["doc_id"]), str(r["ids"])) for r in rows)
    assert P.encode_and_check(none, model).count() == 0
