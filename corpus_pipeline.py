"""The corpus pipeline: language ID, near duplicates, personal data, mixing, pieces.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoline.llm import language, mixing, ngram_join, pieces, pii
from chronoline.session import release, scratch_path, settled_folders

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mix reads 150 % of all words, at most two times a source's own.
FACTOR, MOST = 1.5, 2

#: Rows of a batch sent to a Python worker, at most: whole texts, which both sides hold twice.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_left_over: list[str] = []


def _fresh() -> None:
    """Remove what the stages before have settled: their results are written by now."""
    release(_left_over)
    _left_over.clear()


def _stage(fn):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _fresh()
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
            spark.conf.set(_BATCH, BATCH_ROWS)
        before = set(settled_folders())
        out = fn(spark, docs, sf_dir)
        _left_over.extend(f for f in settled_folders() if f not in before)
        return out

    run_stage.__name__, run_stage.__doc__ = fn.__name__, fn.__doc__
    return run_stage


@_stage
def identified(spark, docs, sf_dir):
    """Documents whose language is identified."""
    return language.keep_identified(docs.select(*COLUMNS))


@_stage
def deduplicated(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


@_stage
def redacted(spark, docs, sf_dir):
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def mixed(spark, docs, sf_dir):
    """Documents as a mix of the sources reads them: one row for each read, one ordered file for each shard."""
    texts = mixing.in_shards(mixing.mixed_texts(mixing.mix(docs.select(*COLUMNS), factor=FACTOR, most=MOST)))
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def encoded(spark, docs, sf_dir):
    """Piece ids of the mix, with the number of pieces and whether they decode to the text."""
    coded = pieces.encode_and_check(docs.select(*COLUMNS), pieces.read_model())
    return coded.select("doc_id", "lang", "source", "n_chars", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("language ID", identified), ("near duplicates", deduplicated), ("personal data", redacted), ("mixing", mixed), ("pieces", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Pieces, posteriors and redaction are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
