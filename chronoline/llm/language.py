"""Language ID by Bayesian evidence fusion.

The text likelihood is a naive Bayes over hashed letter trigrams, learned by grouped sums from
every row that declares a language. Three more pieces of evidence are combined with it, each a
conditional table from grouped sums: the language that the markup declares, the suffix of the
address (the last label of its host and a language code in its path), and the host. Host priors
are smoothed hierarchically: a host leans on its domain, a domain on the whole table. The counts
behind them are of the languages that the texts alone suggest, so they follow the texts and not
the declarations. A row is rejected if its text has too little of any language or no language is
sure enough.

Tables of trigrams and of suffixes are of bounded size. Hosts are joined, never broadcast, and
their counts are combined before the shuffle, so a host with a third of all rows is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoline.llm import shingles as S
from chronoline.llm.common import lean
from chronoline.llm.url_rules import split_url
from chronoline.session import settle

#: Hashed trigrams, and the most languages and suffixes that are told apart (checked).
BUCKETS, MAX_LANGUAGES, MAX_SUFFIXES = 1 << 14, 512, 100_000
#: Bytes of text whose trigrams are counted together: numpy needs some fifty bytes for each.
SLICE = 1 << 19
#: The trigrams of a text are far from independent: their mean log-likelihood counts as so many.
EFFECTIVE = 40.0
#: Weight of the level above in a smoothed prior, and of a uniform guess in a table.
LEAN, GUESS = 20.0, 1.0
#: A row is kept from this posterior on, if its text has this many trigrams.
SURE, LEAST_TRIGRAMS = 0.5, 3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def trigram_counts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the letter trigrams of concatenated texts.

    A-Z count as small letters; whatever is no letter separates words and counts as one space.
    """
    empty = np.zeros(0, np.int64)
    if len(raw) < 3:
        return empty, empty, empty
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first separator after a word
    code = np.where(letter, _FOLD[raw], np.uint32(32))[keep]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[keep]
    if len(code) < 3:
        return empty, empty, empty
    mixed = code[:-2] | code[1:-1] << np.uint32(8) | code[2:] << np.uint32(16)
    mixed = mixed * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    bucket = (mixed * np.uint32(0x85EBCA6B) >> np.uint32(18)).astype(np.int64)
    same = owner[2:] == owner[:-2]
    pair, count = np.unique(owner[2:][same] * BUCKETS + bucket[same], return_counts=True)
    return pair // BUCKETS, pair % BUCKETS, count


def trigram_model(rows: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities (languages, BUCKETS)) from all rows that declare a language."""
    known = rows.where(F.col(lang).isNotNull() & (F.col(lang) != "")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def gather(batches):
        total: dict[str, np.ndarray] = {}
        for b in lean(batches):
            langs = b.column("lang").to_pylist()
            for first, last, raw, at in S.slices(b.column("text"), SLICE):
                owner, bucket, count = trigram_counts(raw, at)
                names, number = np.unique(np.array(langs[first:last], dtype=object).astype(str), return_inverse=True)
                sums = np.bincount(number[owner] * BUCKETS + bucket, count, len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names):
                    total[str(name)] = total.get(str(name), 0) + sums[k]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([np.asarray(v, np.float64).tobytes() for v in total.values()], pa.binary())], ["lang", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "sums": [sum(np.frombuffer(r) for r in pdf["sums"]).tobytes()]})

    found = known.mapInArrow(gather, "lang string, sums binary").groupBy("lang").applyInPandas(add, "lang string, sums binary").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found.sort(key=lambda r: r["lang"])
    if not found:
        return [], np.zeros((0, BUCKETS))
    counts = np.stack([np.frombuffer(r["sums"]) for r in found]) + 0.1
    return [r["lang"] for r in found], np.log(counts / counts.sum(axis=1, keepdims=True))


def text_evidence(rows: DataFrame, text: str, languages: list[str], table: np.ndarray) -> DataFrame:
    """The columns of ``rows`` but the text, with ``ll``, a log-likelihood per language, and ``trigrams``."""
    kept = [c for c in rows.columns if c not in (text, "ll", "trigrams")]
    n = max(1, len(languages))
    scores = table if len(languages) else np.zeros((1, BUCKETS))

    def run(batches):
        for b in lean(batches):
            lls, sizes = [], []
            for first, last, raw, at in S.slices(b.column(text), SLICE):
                owner, bucket, count = trigram_counts(raw, at)
                size = np.bincount(owner, count, last - first)
                ll = np.stack([np.bincount(owner, count * scores[k, bucket], last - first) for k in range(n)], axis=1)
                lls.append(ll / np.maximum(1, size)[:, None] * np.minimum(size, EFFECTIVE)[:, None])
                sizes.append(size)
            flat = np.concatenate(lls).ravel() if lls else np.zeros(0)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), listed, pa.array((np.concatenate(sizes) if sizes else np.zeros(0)).astype(np.int64))], [*kept, "ll", "trigrams"])

    schema = rows.select(*kept, F.lit(None).cast("array<double>").alias("ll"), F.lit(0).cast("long").alias("trigrams")).schema
    return rows.select(*kept, text).mapInArrow(run, schema)


def visible_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>|&[#A-Za-z0-9]+;", " ")


def markup_language(html: Column) -> Column:
    """The language that the html element declares, lower-case and without region; null if none."""
    found = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]+)""", 1)
    return F.nullif(F.lower(found), F.lit(""))


def address_suffix(url: Column) -> Column:
    """The last label of the host and the path's language code, as ``net/fr``."""
    host, path = split_url(url)
    return F.concat(F.regexp_extract(host, r"([a-z0-9-]*)$", 1), F.lit("/"), F.regexp_extract(path, r"^/([a-z]{2})(?:[/-]|$)", 1))


def domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


@dataclass(frozen=True)
class Evidence:
    """Learned tables: log P(value | language) of declarations and suffixes, and the priors."""

    languages: list[str]
    declared: dict
    suffix: dict
    overall: list[float]
    hosts: DataFrame | None


def learn_evidence(seen: DataFrame, languages: list[str], declared: str, suffix: str, host: str) -> Evidence:
    """Tables from rows with their text evidence, by the language that each text alone suggests."""
    n = len(languages)
    if not n:
        return Evidence([], {}, {}, [], None)
    best = F.array_position("ll", F.array_max("ll")).cast("int") - 1
    guessed = seen.where(F.col("trigrams") >= LEAST_TRIGRAMS).withColumn("_l", best)

    # declared and suffix given the language: bounded tables, collected
    def conditional(c: str, most: int) -> dict:
        found = guessed.where(F.col(c).isNotNull()).groupBy(c, "_l").count().limit(most * n + 1).collect()
        if len(found) > most * n:
            raise ValueError(f"more than {most} values of {c}")
        total, values = np.zeros(n), {r[c] for r in found}
        table = {v: np.full(n, GUESS) for v in values}
        for r in found:
            table[r[c]][r["_l"]] += r["count"]
        for v in values:
            total += table[v]
        return {v: np.log(x / total) for v, x in table.items()}

    by_declared, by_suffix = conditional(declared, MAX_LANGUAGES), conditional(suffix, MAX_SUFFIXES)

    # host priors: the host leans on its domain, the domain on all rows
    counts = lambda *by: [F.array(*(F.count_if(F.col("_l") == k) for k in range(n))).alias("c")]
    overall = guessed.agg(*counts()).first()["c"]
    whole = [(c + GUESS) / (sum(overall) + GUESS * n) for c in overall]
    hosts = guessed.where(F.col(host).isNotNull()).groupBy(host).agg(*counts()).withColumn("_d", domain(F.col(host)))
    smooth = lambda c, above: F.transform(F.arrays_zip(c.alias("c"), above.alias("a")), lambda x: (x["c"] + LEAN * x["a"]) / (F.aggregate(c, F.lit(0).cast("long"), lambda s, y: s + y) + LEAN))
    domains = hosts.groupBy("_d").agg(F.array(*(F.sum(F.col("c")[k]) for k in range(n))).alias("dc"))
    domains = domains.select("_d", smooth(F.col("dc"), F.array(*(F.lit(w) for w in whole))).alias("dp"))
    priors = hosts.join(domains, "_d").select(F.col(host).alias("_h"), smooth(F.col("c"), F.col("dp")).alias("_prior"))

    return Evidence(languages, by_declared, by_suffix, whole, settle(priors))


def judge(seen: DataFrame, evidence: Evidence, declared: str, suffix: str, host: str) -> DataFrame:
    """Rows with their text evidence and predicted, posterior and rejected in its place.

    ``declared``, ``suffix`` and ``host`` may be null: no evidence. ``predicted`` is null and the
    row rejected if its text has fewer than ``LEAST_TRIGRAMS`` letter trigrams, if no language is
    known, or if the best posterior is below ``SURE``. Ties go to the smaller name. Repeated rows
    are judged alike.
    """
    languages, n = evidence.languages, len(evidence.languages)
    if not n:
        return seen.drop("ll", "trigrams").withColumn("predicted", F.lit(None).cast("string")).withColumn("posterior", F.lit(0.0)).withColumn("rejected", F.lit(True))

    def looked_up(c: str, table: dict) -> Column:
        none = F.array(*[F.lit(0.0)] * n)
        if not table:
            return none
        known = F.create_map(*(x for v, p in table.items() for x in (F.lit(v), F.array(*(F.lit(float(y)) for y in p)))))
        return F.coalesce(F.element_at(known, F.col(c)), none)

    joined = seen.join(evidence.hosts, seen[host] == evidence.hosts["_h"], "left")
    prior = F.coalesce("_prior", F.array(*(F.lit(w) for w in evidence.overall)))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("ll"), F.transform(prior, lambda p: F.log(p))), add(looked_up(declared, evidence.declared), looked_up(suffix, evidence.suffix)))
    joined = joined.withColumn("_s", logs).withColumn("_m", F.array_max("_s"))
    joined = joined.withColumn("posterior", 1 / F.aggregate("_s", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_m"))))
    names = F.array(*(F.lit(x) for x in languages))
    ok = (F.col("trigrams") >= LEAST_TRIGRAMS) & (F.col("posterior") >= SURE)
    joined = joined.withColumn("predicted", F.when(ok, F.get(names, F.array_position("_s", F.col("_m")).cast("int") - 1)))
    joined = joined.withColumn("posterior", F.when(F.col("trigrams") >= LEAST_TRIGRAMS, F.col("posterior")).otherwise(0.0))
    return joined.withColumn("rejected", F.col("predicted").isNull()).drop("_h", "_prior", "_s", "_m", "ll", "trigrams")


def fuse(rows: DataFrame, languages: list[str], model: np.ndarray, text: str = "text", declared: str = "declared", suffix: str = "suffix", host: str = "host") -> DataFrame:
    """The columns of ``rows`` but the text, judged by tables that are learned from all of them."""
    seen = settle(text_evidence(rows, text, languages, model))
    return judge(seen, learn_evidence(seen, languages, declared, suffix, host), declared, suffix, host)


def identify_pages(pages: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """(page_id, declared, predicted, posterior, rejected) of pages with page_id, url and html."""
    host = F.nullif(split_url(F.col("url"))[0], F.lit(""))
    rows = pages.select(
        "page_id", visible_text(F.coalesce("html", F.lit(""))).alias("text"), markup_language(F.coalesce("html", F.lit(""))).alias("declared"), address_suffix(F.col("url")).alias("suffix"), host.alias("host"),
    )
    return fuse(rows, languages, model).select("page_id", "declared", "predicted", "posterior", "rejected")


def identify_documents(docs: DataFrame, languages: list[str], model: np.ndarray, ident: list[str] | None = None) -> DataFrame:
    """``ident`` columns (all but the text) with predicted, posterior and rejected.

    A document's declared language is its ``lang``; its source stands for the host, and there is
    no address.
    """
    ident = ident or [c for c in docs.columns if c != "text"]
    rows = docs.select(*(F.col(c) for c in ident), "text", F.col("lang").alias("_declared"), F.lit(None).cast("string").alias("_suffix"), F.col("source").alias("_host"))
    found = fuse(rows, languages, model, "text", "_declared", "_suffix", "_host")
    return found.select(*ident, "predicted", "posterior", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified; rejected ones go.

    The tables are learned in a first pass that writes no texts; a second one judges.
    """
    languages, model = trigram_model(docs, "text", "lang")
    names = ("declared", "suffix", "host")
    # the row is packed, so its columns can't clash with those beside it
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.col("text").alias("t"))
    evidence = learn_evidence(settle(text_evidence(rows.select(*names, "t"), "t", languages, model)), languages, *names)
    return judge(text_evidence(rows, "t", languages, model), evidence, *names).where(~F.col("rejected")).select("row.*")
