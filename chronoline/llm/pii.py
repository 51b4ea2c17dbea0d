"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, network addresses, card and telephone numbers. They and
long strings that mix letters and digits are the seeds. What stands before a seed, the last word
and the signs between, is a lexical pattern (``password|=``). Patterns and the identifier-like
strings that follow them form a graph; Spark scores it in rounds: a pattern is as sure as the
share of *all* its occurrences in the corpus, whatever follows, that lead to sure strings, and a
string is as sure as its patterns make it together. A pattern has support by the strings that are
sure in the current round, so strings found through one pattern bring in others. What follows an
accepted pattern is a string too, whatever its form, up to 256 code points: its other places in the corpus are
looked up, and the graph is scored again until no pattern is added. Accepted patterns then mark the whole
token behind them, with or without a digit and of any length.

Counts cover every text. Tasks send sums, so a word that stands before a third of all tokens is a
few rows. All occurrences are counted, in a reading of their own, only for patterns with enough
strings to be accepted at all; more follow as the graph grows. The accepted patterns are a lexicon:
their number is checked before they are shipped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoline.llm.common import lean
from chronoline.llm.terms import Sieve
from chronoline.session import settle

KINDS = ("email", "ip", "card", "phone", "secret")
#: A pattern is accepted from this confidence on, with so many different sure strings at least;
#: the graph is scored in so many rounds at least.
CONFIDENCE, SUPPORT, ROUNDS = 0.5, 3, 3
#: Confidences that move less than this between two rounds, all together, stand still.
STILL = 0.01
#: Bound of the accepted patterns.
MAX_PATTERNS = 1_000_000
#: Entries that a task gathers before it sends them.
HELD = 100_000
#: The longest token, before its closing punctuation is cut, that is a string of the graph.
LONGEST = 256
#: Code points of the texts whose words a task looks up together; rows of a batch that become strings together.
TOGETHER, ROWS = 1 << 19, 256
#: Texts without any of the patterns' words are passed over if there are so many words at most. No
#: result depends on it: a text that has a word at a pattern's place has it somewhere.
FEW_WORDS = 64

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where its digits do: looking back keeps long runs of digits or letters linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Access keys, which may hold no digit.
_ACCESS = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
#: The characters of an identifier-like string.
_PART = re.compile(r"[A-Za-z0-9_+/.-]+")
_BEFORE = re.compile(r"([^\W\d_]+)(\W{1,8})\Z")
_WORD = re.compile(r"[^\W\d_]+")
_ANY = re.compile(r"(?<![^\W\d_])[^\W\d_]++\W{1,8}(?=\w)")
#: The signs, no letters, that have a case.
_FOLDED_SIGNS = re.compile("[\u0345\u24B6-\u24CF]")
_PARTS = re.compile(r"(?<![^\W\d_])([^\W\d_]++)(\W{1,8})(?=\w)")
#: A whole token, whatever its form, and the places of words with the token behind each, cut where it is too long.
_TOKEN = re.compile(r"[^\s\"'`<>()\[\]{},;&|]+")
_STRETCH = re.compile(r"\S+")
_PLACE = re.compile(r"(?<![^\W\d_])[^\W\d_]++\W{1,8}(?=(\w[^\s\"'`<>()\[\]{},;&|]{0,%d}+))" % LONGEST)
#: The tokens, cut alike, that may begin in what stands between white space: wherever a word character follows none.
_BEGUN = re.compile(r"(?<!\w)(?=(\w[^\s\"'`<>()\[\]{},;&|]{0,%d}+))" % LONGEST)
_CLOSING = ".:!?+/-"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(t: str):
    """Matches of the e-mail pattern, searched only where an at sign stands."""
    at, done = t.find("@"), 0
    while at >= 0:
        first = at
        while first > done and (t[first - 1].isalnum() and t[first - 1].isascii() or t[first - 1] in "._%+-"):
            first -= 1
        m = _EMAIL.match(t, first) if first < at else None
        if m:
            yield m.span()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, by start and kind; failing matches are dropped."""
    out = [(a, 0, b) for a, b in _emails(t)] if "@" in t else []
    if _DIGIT.search(t):
        for m in _IP.finditer(t):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(t):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _strong(s: str) -> bool:
    """A string that is an identifier by itself: 16 characters or more, digits and letters well mixed, or an access key."""
    if _ACCESS.fullmatch(s):
        return True
    digits = sum("0" <= c <= "9" for c in s)
    return len(s) >= 16 and digits >= 3 and len(s) - digits >= 3 and len(set(s)) >= 8 and not any(c in "./+" for c in s)


def strings(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, strong) of identifier-like strings, six characters or more with a digit, that touch no base span."""
    digit = _DIGIT.search(t)
    out, k, done = [(*m.span(), True) for m in _ACCESS.finditer(t) if not _DIGIT.search(m[0])] if "AKIA" in t else [], 0, 0
    while digit:
        a = digit.start()
        while a > done and (t[a - 1].isalnum() and t[a - 1].isascii() or t[a - 1] in "_+/.-"):
            a -= 1
        done = b = _PART.match(t, a).end()
        while b > a and t[b - 1] in "+/.-":
            b -= 1
        while a < b and t[a] in "+/.-":
            a += 1
        while k < len(base) and base[k][2] <= a:
            k += 1
        if b - a >= 6 and (k == len(base) or base[k][0] >= b):
            out.append((a, b, _strong(t[a:b])))
        digit = _DIGIT.search(t, done)
    return sorted(out)


def named(word: str, signs: str) -> str:
    """A pattern's name. Case is folded code point by code point, so a word folds alike alone and in its text."""
    return f"{word.casefold()}|{''.join(signs.split())}"


def pattern(t: str, start: int) -> str | None:
    """What stands before a string: the last whole word, its case folded, and the signs between."""
    back = 64
    while True:
        m = _BEFORE.search(t[max(0, start - back) : start])
        if not m or m.start() or back >= start:
            return named(m[1], m[2]) if m else None
        back *= 8  # the word may begin before


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``ROWS`` rows at a time: texts become strings beside the batch that holds them."""
    for b in lean(batches):
        for first in range(0, b.num_rows, ROWS):
            yield b.slice(first, ROWS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """The texts that are not empty."""
    for b in _slices(batches):
        yield from filter(None, b.column(0).to_pylist())


def _together(texts: Iterator[str]) -> Iterator[list[str]]:
    """Stretches of some ``TOGETHER`` code points."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _edges(docs: DataFrame, text: str) -> DataFrame:
    """(pattern, string, seed, n): sums of the tasks."""

    def run(batches):
        edges: Counter = Counter()

        def flush():
            cols = list(zip(*((p, s, seed, n) for (p, s, seed), n in edges.items())))
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64())], ["pattern", "string", "seed", "n"])

        for t in _texts(batches):
            base = base_spans(t)
            for a, b, strong in [(x[0], x[2], True) for x in base] + strings(t, base):
                p = pattern(t, a)
                if p is not None:
                    edges[p, _key(t[a:b]), strong] += 1
            if len(edges) > HELD:
                yield flush()
        if edges:
            yield flush()

    return docs.select(text).mapInArrow(run, "pattern string, string long, seed boolean, n long").groupBy("pattern", "string", "seed").agg(F.sum("n").alias("n"))


def _totals(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): all occurrences of some patterns, whatever follows.

    Spellings, with case and white space as they stand, are counted for some texts at once and then looked
    up, folded together. What the sieve lets through is joined exactly.
    """
    bare = F.regexp_replace("pattern", r"^([^|]*)\|", "$1")
    sieve = Sieve(docs.sparkSession, patterns.select(F.shiftleft(F.crc32(bare.cast("binary")), 31).alias("key")), "key")

    def run(batches):
        totals: Counter = Counter()

        def flush():
            cols = list(zip(*totals.items()))
            totals.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], ["pattern", "total"])

        for texts in _together(_texts(batches)):
            spelled: Counter = Counter()
            for t in texts:
                spelled.update(_ANY.findall(t) if len(t) <= TOGETHER else (m[0] for m in _ANY.finditer(t)))
            every = list(spelled)
            for k in np.flatnonzero(sieve.passes(_crcs(_bare(every)))).tolist():
                word = _WORD.match(every[k])[0]
                totals[named(word, every[k][len(word) :])] += spelled[every[k]]
            if len(totals) > HELD:
                yield flush()
        if totals:
            yield flush()

    found = docs.select(text).mapInArrow(run, "pattern string, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    return found.join(patterns, "pattern", "left_semi")


def _key(s: str) -> int:
    raw = s.encode()
    return zlib.crc32(raw) << 31 | zlib.adler32(raw) & 0x7FFFFFFF


def _crcs(values: list[str]) -> np.ndarray:
    """The part of the keys that a sieve looks at."""
    return np.array([zlib.crc32(s.encode()) for s in values], np.int64) << 31


def _bare(spelled: list[str]) -> list[str]:
    """The names of words and the signs behind them, without the bar, folded all at once: an underscore is in none."""
    if not spelled:
        return []
    if not _FOLDED_SIGNS.search(joined := "_".join(spelled)):
        return "".join(joined.casefold().split()).split("_")
    words = [_WORD.match(s)[0] for s in spelled]
    return [named(w, s[len(w) :]).replace("|", "", 1) for w, s in zip(words, spelled)]


def words_of(known: frozenset[str]) -> list[str] | None:
    """The patterns' words, or None if they are too many to look for one by one."""
    words = {p.partition("|")[0] for p in known}
    return sorted(words) if len(words) <= FEW_WORDS else None


def behind(t: str, known: frozenset[str], words: list[str] | None) -> list[tuple[int, int]]:
    """(start, end) of the whole tokens that follow the patterns, without closing punctuation."""
    if not known or not t or words is not None and not any(w in folded for folded in [t.casefold()] for w in words):
        return []
    out, stop, end = [], -1, -1
    for m in _PARTS.finditer(t):
        if named(m[1], m[2]) in known:
            a = m.end()
            if a >= stop:  # else still inside the last token, which ends at one place
                stop = end = _TOKEN.match(t, a).end()
                while t[end - 1] in _CLOSING:
                    end -= 1
            out.append((a, end))
    return out


def _keys_behind(docs: DataFrame, text: str, known: frozenset[str]) -> DataFrame:
    """(string): the distinct whole tokens, of ``LONGEST`` code points at most, that follow the patterns."""
    words, sent = words_of(known), docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        held: set = set()
        for t in _texts(batches):
            for a, e in behind(t, sent.value, words):
                if _TOKEN.match(t[a : a + LONGEST + 1]).end() <= LONGEST:
                    held.add(_key(t[a:e]))
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], ["string"])
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], ["string"])

    return docs.select(text).mapInArrow(run, "string long").distinct()


def _found_again(docs: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """(pattern, string, seed, n) of every place where one of the strings is a whole token behind any pattern.

    What stands between white space is read once for some texts, with all tokens that may begin in it,
    and only texts that hold one are read place by place. What the sieve lets through is joined exactly.
    """
    sieve = Sieve(docs.sparkSession, keys, "string")

    def run(batches):
        edges: Counter = Counter()

        def flush():
            cols = list(zip(*((p, s, n) for (p, s), n in edges.items())))
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["pattern", "string", "n"])

        for texts in _together(_texts(batches)):
            stretches: set[str] = set()
            for t in texts:
                stretches.update(t.split() if len(t) <= TOGETHER else (m[0] for m in _STRETCH.finditer(t)))
            every = [x for x in _BEGUN.findall(" ".join(stretches)) if len(x) <= LONGEST]
            # the sieve looks at a key's highest bits, which are the checksum's
            passed = np.flatnonzero(sieve.passes(_crcs([x.rstrip(_CLOSING) for x in every]))).tolist()
            wanted = {every[k]: _key(every[k].rstrip(_CLOSING)) for k in passed}
            for t in texts if wanted else ():
                if len(wanted) > FEW_WORDS or any(x in t for x in wanted):
                    for m in _PLACE.finditer(t):
                        if m[1] in wanted:
                            edges[pattern(t, m.end()), wanted[m[1]]] += 1
            if len(edges) > HELD:
                yield flush()
        if edges:
            yield flush()

    found = docs.select(text).mapInArrow(run, "pattern string, string long, n long").groupBy("pattern", "string").agg(F.sum("n").alias("n"))
    return found.join(keys, "string", "left_semi").select("pattern", "string", F.lit(False).alias("seed"), "n")


def _accepted(edges: DataFrame, confidence: float, support: int, rounds: int) -> frozenset[str]:
    """The patterns that the graph accepts, scored until a round adds none and the confidences stand still.

    They only rise from round to round, so their sum says how far any of them has moved.
    """
    sure = edges.groupBy("string").agg(F.max(F.col("seed").cast("double")).alias("sure"))
    accepted, total, done = frozenset(), 0.0, 0
    while True:
        # sums of all strings; support is by those that are sure by now
        scored = settle(edges.join(sure, "string").groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("sure")) / (F.greatest(F.max(F.coalesce("total", F.lit(0))), F.sum("n")) + 1)).alias("confidence"),
            F.count_if(F.col("sure") >= confidence).alias("support"),
        ).where(F.col("support") >= support))
        rows = scored.where(F.col("confidence") >= confidence).select("pattern").limit(MAX_PATTERNS + 1).collect()
        if len(rows) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} accepted patterns")
        before, accepted, done = accepted, frozenset(r["pattern"] for r in rows), done + 1
        last, total = total, scored.agg(F.coalesce(F.sum("confidence"), F.lit(0.0))).first()[0]
        if accepted <= before and total - last < STILL and done >= rounds:
            return accepted
        # noisy or of a string's patterns; seeds stay sure
        sure = settle(edges.join(scored, "pattern", "left").groupBy("string").agg(
            F.greatest(F.max(F.col("seed").cast("double")), 1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce("confidence", F.lit(0.0))))))).alias("sure")
        ))


def learn_patterns(docs: DataFrame, text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> list[str]:
    """The lexical patterns that the graph of all texts makes sure of."""
    edges, totals, accepted = settle(_edges(docs, text)), None, frozenset()
    while True:
        merged = settle(edges.groupBy("pattern", "string").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")))
        # patterns of fewer strings have no support in any round, so their totals count for nothing
        asked = merged.groupBy("pattern").agg(F.count("*").alias("strings")).where(F.col("strings") >= support).select("pattern")
        asked = settle(asked if totals is None else asked.join(totals, "pattern", "left_anti"))
        if totals is None or not asked.isEmpty():
            counted = settle(_totals(docs, text, asked))
            totals = counted if totals is None else totals.unionAll(counted)
        joined = settle(merged.join(totals, "pattern", "left"))
        before, accepted = accepted, _accepted(joined, confidence, support, rounds)
        if accepted <= before:
            return sorted(accepted)
        # what follows the new patterns and is no string of the graph yet
        keys = settle(_keys_behind(docs, text, accepted - before).join(joined.select("string"), "string", "left_anti"))
        if keys.isEmpty():
            return sorted(accepted)
        edges = edges.unionByName(settle(_found_again(docs, text, keys)))


def find(t: str, known: frozenset[str], words: list[str] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: also strong strings and the whole tokens that an accepted pattern leads to."""
    base = base_spans(t)
    more = {a: b for a, b, strong in strings(t, base) if strong or pattern(t, a) in known}
    k, reach = 0, 0
    for a, b in behind(t, known, words):
        while k < len(base) and base[k][0] <= a:  # both lists are in order
            reach = max(reach, base[k][2])
            k += 1
        if b > reach:
            more[a] = max(b, more.get(a, b))
    return base, sorted(base + [(a, 4, b) for a, b in more.items()])


def _name(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def extract(docs: DataFrame, patterns: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with n_email, n_ip, n_card, n_phone, base and spans.

    The counts and ``base`` are the base patterns'; ``spans`` has the found strings too, as
    ``kind:start:end`` by start, then kind, comma-joined; places count code points, ends are
    exclusive. Null and empty texts have no spans. ``patterns`` are learned from ``docs`` if not
    given. Columns with the new names are replaced.
    """
    known = frozenset(learn_patterns(docs, text) if patterns is None else patterns)
    words, sent = words_of(known), docs.sparkSession.sparkContext.broadcast(known)
    new = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
    kept = [c for c in docs.columns if c not in new and c != text]

    def run(batches):
        for b in _slices(batches):
            counts, names, alls = [], [], []
            for t in b.column(text).to_pylist():
                base, spans = find(t or "", sent.value, words)
                counts.append(np.bincount([k for _, k, _ in base], minlength=4))
                names.append(_name(base))
                alls.append(_name(spans))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(n[:, k]) for k in range(4)), pa.array(names, pa.string()), pa.array(alls, pa.string())], [*kept, *new])

    zero = F.lit(0).cast("long")
    schema = docs.select(*kept, *(zero.alias(c) for c in new[:4]), F.lit("").alias("base"), F.lit("").alias("spans")).schema
    return docs.select(*kept, text).mapInArrow(run, schema)


def redacted(t: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [t[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + t[at:]


def redact(docs: DataFrame, patterns: list[str] | None = None, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the spans in the text replaced by their kinds.

    Null texts stay null.
    """
    known, names = frozenset(learn_patterns(docs, text) if patterns is None else patterns), docs.columns
    words, sent = words_of(known), docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for b in _slices(batches):
            out = pa.array([None if t is None else redacted(t, find(t, sent.value, words)[1]) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([out if c == text else b.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)
