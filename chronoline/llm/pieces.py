"""Encoding to and decoding from the pieces of a SentencePiece BPE model.

Words are marked as the model does it (a mark for each space, one before the text) and encoded
once each: the distinct marked words of a batch are sorted, which is the depth-first order of
their trie, and walked with one stack of forward states. A word starts from the state of the
prefix it shares with the word before it.

The forward state of a prefix is the last piece of its segmentation. The model ranks *merges*, so
the segmentation of highest summed score is not what it gives, and a plain Viterbi maximum would
be wrong. The forward step therefore takes the one piece that may follow: a piece p ends a prefix
if the shorter prefix's last piece q and p stay apart when merged in rank order (``Pieces.apart``).
Merges on either side of a boundary that is never merged over don't depend on the other side, so
exactly one p passes, and the back pointers spell the model's own segmentation.

No piece holds a mark after another character (checked), so words are independent. Characters
without a piece become byte pieces. The model file is a parameter; its bytes (half a megabyte)
travel in the closure and nothing is read on the executors.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoline.llm.common import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bound of a worker's memory of words and pairs, and the longest word that is remembered.
WORDS_KEPT, PAIRS_KEPT, LONG_WORD = 50_000, 150_000, 48

_SPLIT = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """A model's pieces, its pair test and a memory of encoded words."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {self.text[i]: -sp.get_score(i) for i in plain}
        self.ids = {self.text[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a mark inside a word")
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece holds a character without a piece")
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [p.replace(MARK, " ").encode() for p in self.text]
        for i in range(n):
            if sp.is_control(i):
                self.raw[i] = b""
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        self.edges: dict[str, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        #: The words of late, and those of before.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Every ending of a piece, and whether it is a piece that its own merges make.
        self.ending: dict[str, bool] = {}

    def prepare(self) -> None:
        """What encoding needs besides; a worker that only decodes is spared it."""
        if self.ending:
            return
        for p in self.ids:
            for k in range(1, len(p)):
                self.ending.setdefault(p[k:], False)
        for p in self.ids:
            self.ending[p] = self.derivation(p) is not None
        self.edges.clear()

    def derivation(self, piece: str):
        """The merges that make a piece: (ranks, right end after each, left end after each); None if others make it up."""
        if piece in self.edges:
            return self.edges[piece]
        parts, ranks, right, left = list(piece), [], [piece[-1]], [piece[0]]
        while len(parts) > 1:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            rank, k = best
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            ranks.append(rank)
            right.append(parts[-1])
            left.append(parts[0])
        self.edges[piece] = found = (ranks, right, left) if len(parts) == 1 else None
        return found

    def apart(self, q: str, p: str) -> bool:
        """Whether q and p, side by side, end as q and p.

        Both sides' merges are played in rank order, the left side first in a tie; the boundary
        is merged over if its own merge comes before either side's next one, or ties with the
        right side's.
        """
        key = self.ids[q] << 20 | self.ids[p]  # a few bytes where two texts would be kept
        known = self.pairs.get(key)
        if known is not None:
            return known
        ranks_q, right, _ = self.derivation(q)
        ranks_p, _, left = self.derivation(p)
        i = j = 0
        while True:
            across = self.rank.get(right[i] + left[j])
            next_q = ranks_q[i] if i < len(ranks_q) else float("inf")
            next_p = ranks_p[j] if j < len(ranks_p) else float("inf")
            if across is not None and across < next_q and across <= next_p:
                result = False
                break
            if next_q == next_p == float("inf"):
                result = True
                break
            if next_q <= next_p:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[key] = result
        return result

    def encode_sorted(self, words: list[str]) -> list[bytes]:
        """32-bit ids of sorted distinct marked words, sharing the states of common prefixes."""
        self.prepare()
        ids, ending, apart = self.ids, self.ending, self.apart
        last: list[str] = [""]  # last[i]: the last piece of the first i characters
        before, out = "", []
        for word in words:
            n, share = len(word), 0
            top = min(n, len(before))
            while share < top and word[share] == before[share]:
                share += 1
            del last[share + 1 :]
            for i in range(share + 1, n + 1):
                found, k, fit = word[i - 1], 2, []
                while k <= i:
                    p = word[i - k : i]
                    whole = ending.get(p)
                    if whole is None:
                        break
                    if whole:
                        fit.append(p)
                    k += 1
                for p in reversed(fit):
                    q = last[i - len(p)]
                    if not q or q not in ids or apart(q, p):
                        found = p
                        break
                last.append(found)
            got, i = [], n
            while i > 0:
                p = last[i]
                i -= len(p)
                number = ids.get(p)
                if number is None:
                    got.extend(self.byte[b] for b in reversed(p.encode()))
                else:
                    got.append(number)
            got.reverse()
            out.append(array("i", got).tobytes())
            before = word
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        split = []  # words without their first mark
        for t in texts:
            words = t.split(" ") if t else []
            if "" in words or MARK in t:  # runs of spaces belong to the next word
                words = [w[1:] for w in _SPLIT.findall(MARK + t.replace(" ", MARK))]
            split.append(words)
        if len(self.words) > WORDS_KEPT:
            self.words, self.older = {}, self.words
        memory, older, long = self.words, self.older, {}
        missing = set().union(*split).difference(memory)
        for word in missing.intersection(older):
            memory[word] = older[word]
        new = sorted(missing.difference(older))
        for word, got in zip(new, self.encode_sorted([MARK + w for w in new])):
            (memory if len(word) <= LONG_WORD else long)[word] = got
        get = {**memory, **long}.__getitem__ if long else memory.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode(errors="replace")


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: Bytes of text that share one sorted walk.
SLICE = 1 << 19


def _groups(texts: pa.Array):
    texts = texts.cast(pa.large_string())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0)
    first, held = 0, 0
    for k, size in enumerate(sizes):
        held += int(size)
        if held >= SLICE or k == len(sizes) - 1:
            yield first, texts.slice(first, k + 1 - first).to_pylist()
            first, held = k + 1, 0


def _ids(column: pa.Array, values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*values, np.zeros(0, np.int32)])
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    mask = column.is_null() if column.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=mask)


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows and columns of ``docs`` with ``ids``, the pieces of each whole text.

    A null text gives null, an empty one an empty list. A column with the new name is replaced.
    Spaces and the mark character itself are one to the model, so a text that holds the mark
    decodes with spaces in its place; all others decode exactly.
    """
    kept = [c for c in docs.columns if c != ids or c == text]

    def run(batches):
        pieces = Pieces(model)  # for one task: workers live on and would keep it
        for b in lean(batches):
            # a batch for each group of texts, so ids don't pile up
            for first, texts in _groups(b.column(text)):
                part = b.slice(first, len(texts))
                listed = _ids(part.column(text), pieces.encode([t or "" for t in texts]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), listed], [*kept, ids])

    schema = docs.select(*kept).withColumn(ids, F.lit(None).cast("array<int>")).schema
    return docs.select(*kept).mapInArrow(run, schema)


def encode_and_check(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", same: str = "round_trip") -> DataFrame:
    """The columns of ``docs`` but the text, with ``ids`` and whether they decode to the text.

    Encoding and decoding share a worker, and the text stays there. A null text gives null ids,
    which decode to null.
    """
    kept = [c for c in docs.columns if c not in (text, ids, same)]

    def run(batches):
        pieces = Pieces(model)  # for one task: workers live on and would keep it
        for b in lean(batches):
            for first, texts in _groups(b.column(text)):
                part = b.slice(first, len(texts))
                values = pieces.encode([t or "" for t in texts])
                ok = [pieces.decode(v) == (t or "") for t, v in zip(texts, values)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _ids(part.column(text), values), pa.array(ok, pa.bool_())], [*kept, ids, same])

    schema = docs.select(*kept, F.lit(None).cast("array<int>").alias(ids), F.lit(None).cast("boolean").alias(same)).schema
    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(docs: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All rows and columns of ``docs`` with the text of the ids; null gives null, no ids the empty text.

    Ids outside the vocabulary are an error.
    """
    kept = [c for c in docs.columns if c != text]

    def run(batches):
        pieces = Pieces(model)  # for one task: workers live on and would keep it
        for b in lean(batches):
            column = b.column(ids)
            flat, offsets = np.asarray(column.values), np.asarray(column.offsets)
            out = [None if not v else pieces.decode(flat[offsets[k] : offsets[k + 1]]) for k, v in enumerate(column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(out, pa.string())], [*kept, text])

    return docs.mapInArrow(run, docs.select(*kept, F.lit(None).cast("string").alias(text)).schema).select(*kept, text)
