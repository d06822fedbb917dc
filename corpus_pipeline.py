"""The corpus pipeline: language ID, quality, near duplicates, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again
as the next stage's docs. The first four return the columns of `documents`; the last returns the pieces
of the packed sequences.

In every stage: rows with null ids are judged like others, and so are rows that repeat an id or a text; very
long texts are read whole; further columns, of any name, pass the first four stages untouched; an empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineshed.llm import decontaminate, jaccard_join, language_id, packing, quality_lm
from lineshed.llm.queries import BATCH_ROWS, HELD_OUT, tokenizer_path
from lineshed.session import materialize, read, ship

#: A text of n trigrams that is less like every language than LEAST_COSINE * n / (n + HALF) is taken for no
#: language. At sf 0.1 held-out documents of 256 trigrams or more have 0.23 at least, and unseen scripts
#: 0.11, random Latin letters 0.19 at most, at any length over 20 words; texts of a word or two are little like any.
LEAST_COSINE = 0.215
HALF = 60


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, null and empty ones among them, and texts unlike every learned language.

    A text at the bound stays; equal texts share their fate.
    """
    _prepare(spark)
    profiles = language_id.fit(docs.filter(f"not {HELD_OUT}"))
    return language_id.keep_known(docs, profiles, LEAST_COSINE, HALF)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose perplexity is above their language's threshold, and null and empty ones.

    A text at the threshold stays; equal texts of a language share their fate.
    """
    _prepare(spark)
    return quality_lm.keep(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each near-duplicate class.

    A text without words is a class of its own, as is a row with null id; of rows that repeat an id with
    equal text one stays.
    """
    _prepare(spark)
    return jaccard_join.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none."""
    _prepare(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of the packed sequences.

    A null or empty text is one piece, its end id; of pieces of equal length that of the least id goes first.
    """
    _prepare(spark)
    pieces = packing.tokenize(docs, tokenizer_path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, docs.count()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: No stage can be told in SQL; the tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, each on what the one before has written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
