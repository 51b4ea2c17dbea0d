"""Benchmark decontamination by a prefix-filtered join of shingles.

An item is cut into windows of ``WIDTH`` consecutive terms; an item of fewer terms is one window.
The containment asked for is whole: a document has a window if all its terms stand there in a row.
So every shingle of the window is necessary, and the prefix that must be joined is its rarest one.

1. The items' shingles are counted in all documents; a window that holds a shingle of no document is
   out, the others are filed under their rarest shingle.
2. Documents send a row for each place of such a shingle, with the terms around it. A sieve of a
   bounded size picks the places; what it lets through is joined exactly.
3. Joined pairs must fit by length and place (enough terms before and behind the shingle), then
   term by term. Texts themselves are never shuffled.

Rows are documents: repeated ids are judged apart if their texts differ, and repeated rows alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronoline.llm.shingles import slices
from chronoline.llm.terms import Sieve, Terms, spaced_terms
from chronoline.session import settle

#: Terms of a window and of a shingle.
WIDTH, SHINGLE = 10, 3
#: Shares into which the places of one shingle are dealt, so that a common one is many tasks.
SALTS = 16
#: Bytes of copied text in one batch that a task sends.
SENT = 1 << 24


def _strings(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def item_windows(items: DataFrame, ident: str = "item_id", text: str = "text", width: int = WIDTH, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(windows, owners): the distinct windows with their shingles' keys in order, and the items of each.

    Windows have wid (md5 of the terms), words (array), keys. Items without terms have none; a null
    item id counts as the empty text.
    """
    words = F.filter(F.split(spaced_terms(F.col(text)), " "), lambda w: w != "")
    listed = items.select(F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("item"), words.alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - width + 1))
    cut = listed.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), width).alias("words"))
    owners = settle(cut.select(F.md5(F.array_join("words", " ").cast("binary")).alias("wid"), "item", "words").distinct())

    def keyed(batches):
        for b in batches:
            out = []
            for first, last, raw, at in slices(b.column("line")):
                t = Terms(raw, at)
                sizes = np.diff(t.begin)
                found = {w: t.shingles(w) for w in np.unique(np.minimum(sizes, shingle)).tolist() if w}
                for d in range(last - first):
                    keys, place = found[min(int(sizes[d]), shingle)]
                    out.append(keys[np.searchsorted(place, t.begin[d]) : np.searchsorted(place, t.begin[d + 1])])
            yield pa.RecordBatch.from_arrays([b.column("wid"), b.column("words"), pa.array(out, pa.list_(pa.int64()))], ["wid", "words", "keys"])

    distinct = owners.select("wid", "words", F.array_join("words", " ").alias("line")).dropDuplicates(["wid"])
    return settle(distinct.mapInArrow(keyed, "wid string, words array<string>, keys array<long>")), owners.select("wid", "item")


def _counts(docs: DataFrame, text: str, widths: list[int], sieve: Sieve) -> DataFrame:
    """(key, n): how often shingles that pass the sieve occur in all documents."""

    def run(batches):
        for b in batches:
            for _, _, raw, at in slices(b.column(0)):
                t = Terms(raw, at)
                for w in widths:
                    keys, _ = t.shingles(w)
                    some, n = np.unique(keys[sieve.passes(keys)], return_counts=True)
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n.astype(np.int64))], ["key", "n"])

    return docs.select(text).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, ident: str, text: str, widths: list[int], width: int, sieve: Sieve) -> DataFrame:
    """A row for every document (place null) and one for each place of a shingle that passes the sieve.

    Columns are doc, tkey (the text's hash), n_words, place, key, and the terms before and from the
    place on, as many as a window may take.
    """
    names = ["doc", "tkey", "n_words", "place", "key", "before", "behind"]
    ids = docs.schema[ident].dataType

    def run(batches):
        for b in batches:
            for first, last, raw, at in slices(b.column("text")):
                t = Terms(raw, at)
                doc, tkey = b.column("doc").slice(first, last - first), b.column("tkey").slice(first, last - first)
                sizes, n = np.diff(t.begin), last - first
                none = [pa.nulls(n, kind) for kind in (pa.int64(), pa.int64(), pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([doc, tkey, pa.array(sizes.astype(np.int64)), *none], names)
                number = np.repeat(np.arange(n), sizes)
                for w in widths:
                    keys, place = t.shingles(w)
                    some = np.flatnonzero(sieve.passes(keys))
                    step = max(1, SENT // (16 * (2 * width + 1)))
                    for lo in range(0, len(some), step):
                        at_, key = place[some[lo : lo + step]], keys[some[lo : lo + step]]
                        own = number[at_]
                        before = _strings(*t.slices(np.maximum(at_ - width, t.begin[own]), at_))
                        behind = _strings(*t.slices(at_, np.minimum(at_ + width, t.begin[own + 1])))
                        row = pa.array(own)
                        yield pa.RecordBatch.from_arrays(
                            [doc.take(row), tkey.take(row), pa.array(sizes[own].astype(np.int64)), pa.array((at_ - t.begin[own]).astype(np.int64)), pa.array(key), before, behind], names
                        )

    rows = docs.select(F.col(ident).alias("doc"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    schema = rows.select("doc", "tkey").schema.add("n_words", "long").add("place", "long").add("key", "long").add("before", "string").add("behind", "string")
    assert schema["doc"].dataType == ids
    return rows.mapInArrow(run, schema)


def hits(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, owners): every document, every occurrence of a window, and the windows' items.

    ``documents`` has doc, tkey and n_words for each row of ``docs``; ``hits`` the distinct doc, tkey,
    start, n and wid of windows found, counted in terms; ``owners`` the items of each wid.
    """
    windows, owners = item_windows(items, item, item_text, width, shingle)
    widths = sorted(r["w"] for r in windows.select(F.least(F.size("words"), F.lit(shingle)).alias("w")).distinct().collect())  # at most ``shingle`` rows
    keys = windows.select("wid", F.posexplode("keys").alias("offset", "key"))
    count = _counts(docs, text, widths, Sieve(docs.sparkSession, keys.select("key").distinct(), "key"))
    known = keys.join(count, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.groupBy("wid").agg(F.min(F.struct("n", "key", "offset")).alias("r")).where("r.n > 0").select("wid", "r.key", "r.offset")
    line = lambda words: F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).otherwise(" ")
    filed = settle(windows.join(rarest, "wid").select(
        "wid", "key", "offset", F.size("words").alias("n"), line(F.slice("words", 1, F.col("offset"))).alias("head"), line(F.slice("words", F.col("offset") + 1, width)).alias("tail"),
    ))
    found = settle(_places(docs, ident, text, widths, width, Sieve(docs.sparkSession, filed.select("key").distinct(), "key")))
    # the places of one shingle are dealt over SALTS shares, its windows sent to each
    salt = F.pmod(F.xxhash64("doc", "tkey", "place"), F.lit(SALTS)).cast("int")
    spaced = lambda c: F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), " +", " ")
    places = found.where("place IS NOT NULL").select("doc", "tkey", "n_words", "place", "key", spaced(F.col("before")).alias("before"), spaced(F.col("behind")).alias("behind"), salt.alias("salt"))
    salted = filed.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    fits = (F.col("place") >= F.col("offset")) & (F.col("n_words") - F.col("place") >= F.col("n") - F.col("offset"))  # by place and length
    same = F.col("before").endswith(F.col("head")) & F.col("behind").startswith(F.col("tail"))
    pairs = places.join(salted, ["key", "salt"]).where(fits & same)
    started = pairs.select("doc", "tkey", (F.col("place") - F.col("offset")).alias("start"), "n", "wid").distinct()
    return found.where("place IS NULL").select("doc", "tkey", "n_words"), settle(started), owners


def judge(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: its id, n_words, n_hit (words inside any window found) and items.

    ``items`` are the ids, as texts and in their order, of the items with windows found. Null and
    empty texts have no words and no hits; empty tables give no hits. Only the id and the text are
    read, so other columns may have any names.
    """
    every, started, owners = hits(docs, items, ident, text, item, item_text, width, shingle)
    same = ["doc", "tkey"]
    # covered words by a running end: the starts of one text are at most its words
    before = Window.partitionBy(*same).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    longest = started.groupBy(*same, "start").agg(F.max("n").alias("n"))
    new = F.col("start") + F.col("n") - F.greatest("start", F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0)))
    covered = longest.withColumn("new", F.greatest(F.lit(0), new)).groupBy(*same).agg(F.sum("new").cast("long").alias("n_hit"))
    named = started.select(*same, "wid").distinct().join(owners, "wid").groupBy(*same).agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = covered.join(named, [covered["doc"].eqNullSafe(named["doc"]), covered["tkey"] == named["tkey"]]).select(covered["doc"].alias("hdoc"), covered["tkey"].alias("hkey"), "n_hit", "items")
    joined = every.join(both, [every["doc"].eqNullSafe(both["hdoc"]), every["tkey"] == both["hkey"]], "left")
    return joined.select(
        F.col("doc").alias(ident), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
