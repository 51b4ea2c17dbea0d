"""Bibliographic records: merging, counting, ranking, keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoline.functions.numbers import let
from chronoline.functions.text import citation_stem, clash_suffix, hits, title_key
from chronoline.operators.blocks import Blocks, row_numbers
from chronoline.session import settle

# fixed values: notices that are not papers, as each ranking knows them
BROAD_NOTICES = r"retract|erratum|correction to|editorial|comment on"
TITLE_NOTICES = r"retract|erratum|correction to|editorial|^comment"
SHORTLIST_NOTICES = r"retract|erratum|correction to|^comment on|editorial|author correction|supplementary|abstracts? from|conference abstract"
# fixed values: record types that earn a small bonus
PAPER_TYPES = ("article", "inproceedings", "conference", "proceedings-article")


@dataclass(frozen=True)
class Topic:
    """What a topic's records look like.

    ``must``: at least one in the text. ``bonus``: add to the score. ``groups``: pairs of
    ("title" | "text", patterns), each needing a hit. ``exclude``: none in the title.
    ``any_of``: alternatives of which one must hold besides.
    """

    must: Sequence[str] = ()
    bonus: Sequence[str] = ()
    groups: Sequence[tuple[str, Sequence[str]]] = ()
    exclude: Sequence[str] = ()
    any_of: Sequence[Topic] = ()


@dataclass(frozen=True)
class Scoring:
    """Points of a ranking: pattern weights, citation curve, recency steps, extras.

    ``notices`` is looked for in the title or the text as ``notices_in`` says, bonus patterns as
    ``bonus_in`` says; ``paratext`` is the penalty of that record type; ``positive`` keeps only
    scores above zero.
    """

    must: float
    bonus: float
    cites_cap: int
    cites_power: float
    years: Sequence[tuple[int, float]]
    abstract: float
    doi: float
    kind: float
    notice: float
    notices: str = ""
    notices_in: str = "title"
    bonus_in: str = "text"
    paratext: float = 0.0
    positive: bool = False


# fixed values: the rankings in use, from broad to strict
SCORINGS = {
    "broad": Scoring(3.0, 1.0, 3000, 0.35, ((2015, 1.5),), 0.5, 0.0, 0.5, 15.0, BROAD_NOTICES, "text", positive=True),
    "titles": Scoring(0.0, 0.0, 5000, 0.4, ((2015, 4.0), (2020, 2.0)), 1.0, 1.0, 0.0, 50.0, TITLE_NOTICES),
    "shortlist": Scoring(0.0, 2.0, 8000, 0.4, ((2015, 3.0), (2019, 2.0)), 1.5, 1.0, 0.0, 60.0, SHORTLIST_NOTICES, paratext=60.0),
    "strict": Scoring(0.0, 3.0, 5000, 0.4, ((2015, 4.0), (2020, 3.0)), 0.0, 0.0, 0.0, 0.0, bonus_in="title"),
}


# fixed values: the six topics of the bibliography
TOPICS: dict[str, Topic] = {
    "1_video_rodent": Topic(
        (r"\brodent", r"\bmice\b", r"\bmouse\b", r"\brat\b", r"\brats\b", r"racine", r"preclinical", r"animal model"),
        (r"video", r"seizure", r"convuls", r"behavio", r"epilep", r"camera", r"automat"),
    ),
    "2_ecg_cardiac": Topic(
        (r"\becg\b", r"electrocardiogra", r"heart rate", r"cardiac", r"tachycardia", r"\bhrv\b", r"photoplethysmo", r"\bppg\b", r"pulse"),
        (r"seizure", r"epilep", r"ictal", r"detect"),
    ),
    "3_animal_behavior_dl": Topic(
        (r"deeplabcut", r"sleap", r"pose estimation", r"markerless", r"behavio", r"ethology", r"tracking"),
        (r"animal", r"rodent", r"mice", r"mouse", r"deep learning", r"neural network", r"phenotyp"),
    ),
    "4_imbalance": Topic(
        (r"imbalanc", r"long-tail", r"long tail", r"rare event", r"focal loss", r"class-imbalance", r"resampl", r"minority class", r"anomaly detect"),
        (r"deep", r"neural", r"medical", r"time series", r"video", r"classif", r"detect"),
    ),
    "5_cross_subject": Topic(
        (r"cross-subject", r"cross subject", r"subject-independent", r"subject independent", r"inter-subject", r"leave-one-subject",
         r"patient-independent", r"patient independent", r"subject-wise", r"external validation", r"generaliz", r"domain shift", r"domain adapt"),
        (r"eeg", r"physiolog", r"biomedical", r"clinical", r"seizure", r"subject", r"patient", r"variabil"),
    ),
    "6_false_alarm": Topic(
        (r"false alarm", r"false positive", r"false detection", r"alarm fatigue", r"per hour", r"\bfp/h\b", r"specificity"),
        (r"seizure", r"monitor", r"eeg", r"icu", r"detect", r"wearable", r"clinical", r"continuous"),
    ),
}


def _keyed(records: DataFrame, title: str, min_key_len: int) -> DataFrame:
    """Records with a digest of their title key; those of a short key are left out."""
    return records.withColumn("title_digest", _digest(title, min_key_len)).filter("title_digest IS NOT NULL")


def _digest(title: str, min_key_len: int) -> Column:
    """Digest of the title key, which is computed once; null if the key is short."""
    return let(title_key(F.col(title)), lambda k: F.when(F.length(k) >= min_key_len, F.sha2(k, 256)))


def merge_records(
    records: DataFrame, order: str, fields: Sequence[str] = (), min_key_len: int = 12, title: str = "title",
    source: str = "source_api", cites: str = "cited_by_count", ident: str | None = None,
) -> DataFrame:
    """One record per normalised title.

    Keeps the first non-empty value of each field in the declared order, the largest
    citation count and the sources in order of appearance; with ``ident``, also the first
    record id of each source, as ``record_ids``. Groups are keyed by a digest of the title key
    and aggregated before the shuffle, so a title with very many copies costs one row per task.
    """
    keyed = _keyed(records, title, min_key_len)
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    own = [] if ident is None else [F.min_by(F.col(ident).cast("string"), order).alias("_i")]
    per_source = keyed.groupBy("title_digest", source).agg(
        F.min(order).alias("_o"), F.count(F.lit(1)).alias("_n"), F.max(cites).alias("_c"), *own,
        *[F.min_by(F.struct(F.col(order).alias("o"), F.col(f).alias("v")), F.when(filled(f), F.col(order))).alias(f"_f_{f}") for f in fields],
    )
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_o", c))), lambda x: x[c])
    return per_source.groupBy("title_digest").agg(
        F.min("_o").alias(order), F.sum("_n").alias("n_records"), F.max("_c").alias(cites), F.array_join(in_order(source), "+").alias("sources"),
        *([] if ident is None else [F.array_join(in_order("_i"), " | ").alias("record_ids")]),
        *[F.min_by(F.col(f"_f_{f}.v"), F.col(f"_f_{f}.o")).alias(f) for f in fields],
    )


def also_queries(records: DataFrame, order: str, query: str = "source_query", min_key_len: int = 12, title: str = "title") -> DataFrame:
    """(title_digest, order, query) of the records merged into the first one of their title.

    A table beside the merged records, in the declared order: a list inside one would grow with the copies.
    The titles are read once: what is kept of them is settled before it meets the first of each title.
    """
    keyed = settle(records.select(_digest(title, min_key_len).alias("title_digest"), order, query)).filter("title_digest IS NOT NULL")
    first = keyed.groupBy("title_digest").agg(F.min(order).alias("_first"))
    return keyed.join(first, "title_digest").filter(F.col(order) > F.col("_first")).select("title_digest", order, query)


def count_records(records: DataFrame, by: str, doi: str | None = None) -> DataFrame:
    """Records per group and how many carry an identifier."""
    extra = [] if doi is None else [F.count_if(F.coalesce(F.col(doi), F.lit("")) != "").alias("with_doi")]
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *extra)


def relevant(topic: Topic, title: Column, text: Column) -> Column:
    """Does a record satisfy the topic's rules."""
    ok = hits(text, topic.must) > 0 if topic.must else F.lit(True)
    for where, patterns in topic.groups:
        ok = ok & (hits(title if where == "title" else text, patterns) > 0)
    if topic.exclude:
        ok = ok & (hits(title, topic.exclude) == 0)
    if topic.any_of:
        one = F.lit(False)
        for t in topic.any_of:
            one = one | relevant(t, title, text)
        ok = ok & one
    return ok


def topic_score(
    topic: Topic, title: Column, text: Column, cites: Column, year: Column | None = None, abstract: Column | None = None,
    doi: Column | None = None, kind: Column | None = None, scoring: Scoring = SCORINGS["broad"],
) -> Column:
    """Score of a record under a ranking (O04); null where the topic's rules fail."""
    points = lambda test, n: F.when(test, F.lit(n)).otherwise(F.lit(0.0))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    # whole points first: records with equal points and citations have equal sums
    score = F.lit(0.0)
    if scoring.must and topic.must:
        score = score + hits(text, topic.must) * F.lit(scoring.must)
    if scoring.bonus and topic.bonus:
        score = score + hits(title if scoring.bonus_in == "title" else text, topic.bonus) * F.lit(scoring.bonus)
    score = score + F.pow(F.least(F.greatest(cites, F.lit(0)), F.lit(scoring.cites_cap)).cast("double"), F.lit(scoring.cites_power))
    if year is not None:
        for since, n in scoring.years:
            score = score + points(year >= since, n)
    for value, n in ((abstract, scoring.abstract), (doi, scoring.doi)):
        if value is not None and n:
            score = score + points(filled(value), n)
    if kind is not None and scoring.kind:
        score = score + points(kind.isin(*PAPER_TYPES), scoring.kind)
    if kind is not None and scoring.paratext:
        score = score - points(F.coalesce(kind == "paratext", F.lit(False)), scoring.paratext)
    if scoring.notice:
        score = score - points((text if scoring.notices_in == "text" else title).rlike(scoring.notices), scoring.notice)
    return F.when(relevant(topic, title, text), score)


def top_per_topic(
    records: DataFrame, topics: Mapping[str, Topic], n: int, ident: str, title: Column, text: Column, cites: Column,
    scoring: str = "broad", **parts: Column,
) -> DataFrame:
    """The n best records of every topic, identifier order on ties.

    Scores that agree in nine digits are ties; the scores themselves are not rounded.
    Broad rankings keep positive scores only; the others keep every match.

    Rules are column expressions, so records are read once whatever the number of
    topics; the rank limit is applied before the shuffle by Spark.
    """
    rules = SCORINGS[scoring]
    scored = records.withColumn("_ti", F.lower(title)).withColumn("_tx", F.lower(text)).select(
        ident, F.explode(F.array(*[
            F.struct(
                F.lit(name).alias("topic"),
                topic_score(t, F.col("_ti"), F.col("_tx"), cites, scoring=rules, **parts).alias("score"),
            )
            for name, t in topics.items()
        ])).alias("_s"),
    ).select(ident, "_s.*").filter(F.col("score") > 0 if rules.positive else F.col("score").isNotNull())
    spec = W.partitionBy("topic").orderBy(F.round("score", 9).desc(), F.col(ident).asc_nulls_last())
    return scored.withColumn("place", F.row_number().over(spec)).filter(F.col("place") <= n).withColumn(
        "place", F.col("place").cast("bigint")
    )


def citation_keys(
    records: DataFrame, order: str, author: Column, year: Column, title: Column, blocks: Blocks = Blocks(width=10_000.0)
) -> DataFrame:
    """Citation key of every record; clashes are told apart in the declared order."""
    stems = records.withColumn("_stem", citation_stem(author, year, title)).select(order, "_stem")
    numbered = row_numbers(stems, ["_stem"], order, "_n", blocks=blocks)
    return numbered.select(order, F.concat("_stem", clash_suffix(F.col("_n").cast("int"))).alias("cite_key"))


def normal_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(dx\.)?doi\.org/", "")


def verify_keys(finalists: DataFrame, catalogue: DataFrame, doi: str = "doi", carry: Sequence[str] = ()) -> DataFrame:
    """Finalists found in the catalogue, the others with a reason."""
    left = finalists.withColumn("_doi", normal_doi(F.col(doi)))
    right = catalogue.select(normal_doi(F.col(doi)).alias("_doi"), F.lit(1).alias("_hit"), *carry).dropDuplicates(["_doi"])
    j = left.join(right, "_doi", "left")
    return j.withColumn("status", F.when(F.col("_hit").isNull(), "NOT_FOUND").otherwise("verified")).drop("_hit", "_doi")


def venue_notes(records: DataFrame, abbreviations: DataFrame, venue: str = "venue") -> DataFrame:
    """Abbreviation note where a venue has one that differs from its name."""
    j = records.join(abbreviations.select(venue, "abbrev"), venue, "left")
    return j.withColumn("note", F.when(F.col("abbrev").isNotNull() & (F.col("abbrev") != F.col(venue)), F.concat(F.lit("abbrev: "), F.col("abbrev")))).drop("abbrev")
