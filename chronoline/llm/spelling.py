"""Spelling variants: words one inserted, deleted or replaced code point apart, by dense tiles.

Two different words are near if their common prefix and their common suffix together reach the longer
one's length minus one. Of such a pair with the longer length L, cut anywhere at m, the words share
either the first m code points or the last L - m. So every word is filed, for L its own length and one
more, under its head and under its tail; groups of more than ``TILE`` words are cut again at the middle
of what is still open, until at most one code point is: such a group is no larger than the alphabet.
A pair is counted where its exact prefix says, so in one group only.

Groups lie one after another in padded matrices of code points. Blocks of ``BLOCK`` rows are compared
with themselves and with the blocks that their groups reach, all at once; pairs never leave the task,
which sends one row for each word of a group: its number of near words and the most frequent of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from chronoline.session import settle

#: Words of a group that is compared whole; rows of a block; compared code points held at a time.
TILE, BLOCK, CELLS = 256, 16, 1 << 21
#: Code points of the rows that a task gathers before it compares them, with complete groups.
GATHERED = 1 << 20
#: Shares into which the rows of one group are dealt while it is cut.
SALTS = 16
#: Words that a task gathers before it sends their counts.
HELD = 200_000
#: The least code points and occurrences of a word, how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10

_KEY = ["long", "lo", "end", "hi", "head", "tail"]
_PAD = np.uint32(0xFFFFFFFF)


def runs(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, drop: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters of whole texts, A-Z lowered, with their occurrences.

    Letters are A-Z, a-z and U+00C0 to U+00FF; runs of fewer than ``least`` code points are left out.
    With ``drop``, a run loses one code point where that number divides the crc32 of ``<id>:<run>``:
    the one at the crc32 modulo the run's length. Null texts have no runs, a null id is empty.
    """
    found = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for ident_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                raw = t.encode("latin-1", "replace").lower()  # one byte a code point, only A-Z are lowered
                own = Counter(m[0] for m in found.finditer(raw)) if len(raw) > 1 << 22 else Counter(found.findall(raw))
                if drop is None:
                    total.update(own)
                else:
                    start = zlib.crc32(f"{ident_ or ''}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % drop == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < least:
                                continue
                        total[word] += n
                if len(total) > HELD:
                    yield _sent(total)
                    total.clear()
        if total:
            yield _sent(total)

    def _sent(total):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col(ident).cast("string"), F.col(text)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _filed(rows: DataFrame, parts: list[tuple]) -> DataFrame:
    """The rows once for each (lo, end, hi), with the head and tail that name the group."""
    cut = F.explode(F.array(*(F.struct(lo.cast("int").alias("lo"), end.cast("int").alias("end"), hi.cast("int").alias("hi")) for lo, end, hi in parts)))
    flat = rows.select("word", "n", "long", cut.alias("c")).select("word", "n", "long", "c.lo", "c.end", "c.hi")
    return flat.withColumn("head", F.expr("left(word, lo)")).withColumn("tail", F.expr("right(word, long - end)"))


def _groups(words: DataFrame, tile: int) -> DataFrame:
    """Words with the groups they are compared in, every near pair in exactly one of them."""
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("long"))
    middle = F.floor(F.col("long") / 2)
    nothing, whole = F.lit(0), F.col("long")
    # words of no code points have only themselves to share
    open_ = _filed(sized.where("long > 1"), [(middle, whole, whole + 1), (nothing, middle, middle)])
    ready = _filed(sized.where("long = 1"), [(nothing, whole, whole + 1)])
    salt = F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")
    while True:
        open_ = settle(open_)
        hot = settle(open_.groupBy(*_KEY).count().where((F.col("count") > tile) & (F.col("end") - F.col("lo") > 1)).drop("count"))
        if hot.isEmpty():
            return ready.unionByName(open_)
        salted, dealt = hot.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS))))), open_.withColumn("salt", salt)
        ready = ready.unionByName(dealt.join(salted, [*_KEY, "salt"], "left_anti").drop("salt"))
        middle = F.floor((F.col("lo") + F.col("end")) / 2)
        again = dealt.join(salted, [*_KEY, "salt"], "left_semi").select("word", "n", "long", "lo", "end", "hi")
        cut = F.explode(F.array(
            F.struct(middle.cast("int").alias("lo"), F.col("end"), F.col("hi")), F.struct(F.col("lo"), middle.cast("int").alias("end"), F.least("hi", middle).cast("int").alias("hi")),
        ))
        flat = again.select("word", "n", "long", cut.alias("c")).select("word", "n", "long", "c.lo", "c.end", "c.hi")
        open_ = flat.withColumn("head", F.expr("left(word, lo)")).withColumn("tail", F.expr("right(word, long - end)"))


def _matrix(words: list[str], long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the front and from the back, padded to ``long``, and the lengths."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    row, begin = np.repeat(np.arange(len(words)), size), np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(flat)) - begin[row]
    front = np.full((len(words), long), _PAD, np.uint32)
    back = front.copy()
    front[row, place] = flat
    back[row, size[row] - 1 - place] = flat
    return front, back, size


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal entries from the first one on, along the last axis."""
    differ = a != b
    return np.where(differ.any(axis=-1), differ.argmax(axis=-1), differ.shape[-1])


def near_pairs(words: list[str], group: np.ndarray, hi: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with i < j of the near words of one group whose common prefix is below the group's ``hi``.

    All groups have the longer length ``long``; the rows of a group stand together.
    """
    n = len(words)
    front, back, size = _matrix(words, long)
    blocks = -(-n // BLOCK)
    padded = np.full((blocks * BLOCK, long), _PAD, np.uint32)
    padded[:n] = front
    padded = padded.reshape(blocks, BLOCK, long)
    number = np.full(blocks * BLOCK, -1, np.int64)
    number[:n] = group
    number = number.reshape(blocks, BLOCK)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, CELLS // (BLOCK * BLOCK * long))
    last = number[:, -1].copy()
    last[-1] = group[-1]
    ahead, reach = 0, np.arange(blocks)
    while len(reach):
        for lo in range(0, len(reach), step):
            k = reach[lo : lo + step]
            one, two = number[k], number[k + ahead]
            maybe = (one[:, :, None] == two[:, None, :]) & (one >= 0)[:, :, None]
            if ahead == 0:
                maybe &= np.triu(np.ones((BLOCK, BLOCK), bool), 1)
            prefix = _shared(padded[k][:, :, None, :], padded[k + ahead][:, None, :, :])
            at, x, y = np.nonzero(maybe)
            i, j = k[at] * BLOCK + x, (k[at] + ahead) * BLOCK + y
            p = prefix[at, x, y]
            some = (p < hi[i]) & (np.maximum(size[i], size[j]) == long)
            i, j, p = i[some], j[some], p[some]
            near = p + _shared(back[i], back[j]) >= long - 1
            left.append(i[near])
            right.append(j[near])
        ahead += 1
        reach = reach[reach + ahead < blocks]
        reach = reach[last[reach] == number[reach + ahead, 0]]
    return np.concatenate(left), np.concatenate(right)


def _compared(batches):
    """One row for each word of a group that has near words there: how many, and the most frequent."""
    held: pa.Table | None = None

    def done(t: pa.Table):
        key, long = t.column("key").combine_chunks(), t.column("long").to_numpy()
        fresh = np.ones(t.num_rows, bool)
        if t.num_rows > 1:
            fresh[1:] = pc.not_equal(key.slice(1), key.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
        fresh[1:] |= long[1:] != long[:-1]
        group = np.cumsum(fresh)
        words, n, hi = t.column("word").to_pylist(), t.column("n").to_numpy(), t.column("hi").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], long[1:] != long[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):  # one length after another
            i, j = near_pairs(words[a:b], group[a:b], hi[a:b], int(long[a]))
            if not len(i):
                continue
            own, other = np.concatenate([i, j]) + a, np.concatenate([j, i]) + a
            order = np.lexsort((other, -n[other], own))  # rows of a group are in the words' order
            own, other = own[order], other[order]
            first, count = np.unique(own, return_index=True, return_counts=True)[1:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[k] for k in own[first]], pa.string()), pa.array(count.astype(np.int64)), pa.array(n[other[first]]), pa.array([words[k] for k in other[first]], pa.string())],
                ["word", "n_near", "most", "best"],
            )

    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if int(pc.sum(held.column("long")).as_py() or 0) < GATHERED:
            continue
        key = held.column("key").combine_chunks()
        differ = np.flatnonzero(pc.not_equal(key, key[held.num_rows - 1]).to_numpy(zero_copy_only=False))
        if len(differ):  # the last group may go on in the next batch
            yield from done(held.slice(0, int(differ[-1]) + 1))
            held = held.slice(int(differ[-1]) + 1)
    if held is not None and held.num_rows:
        yield from done(held)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, most, best) of the words that have near ones: their number, the largest n and its word.

    ``words`` has distinct words with n. Ties of n go to the smallest word in code-point order.
    """
    grouped = _groups(words, tile)
    key = F.concat_ws("\u0000", F.col("lo").cast("string"), F.col("end").cast("string"), "head", "tail")  # the rows' lengths tell heads from tails
    rows = grouped.select("word", "n", "long", "hi", key.alias("key")).repartition("long", "key").sortWithinPartitions("long", "key", "hi", "word")
    found = rows.mapInArrow(_compared, "word string, n_near long, most long, best string")
    best = F.min(F.struct((-F.col("most")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("most"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends, by doubling; n grows along it, so it ends."""
    state = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        state = moved.select("word", "root")


def group_variants(counts: DataFrame, least: int = LEAST_COUNT, factor: int = FACTOR, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words that occur ``least`` times or more.

    ``counts`` has (word, n); rows of one word are added, null words left out. A word's form is its
    most frequent near word if that is ``factor`` times as frequent at least, else null; its root is
    where the forms lead, itself if it has none. Ties go to the smallest word in code-point order.
    """
    words = settle(counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    near = settle(near_words(words, tile))
    joined = settle(words.join(near, "word", "left").withColumn("formed", F.coalesce(F.col("most") >= factor * F.col("n"), F.lit(False))).select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("formed"), F.col("best")).alias("form"), F.when(F.col("formed"), F.col("most")).alias("form_n"),
    ))
    roots = _roots(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
