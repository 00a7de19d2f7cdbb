"""A corpus pipeline: toxicity, line dedup, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import jaccard, linededup, mixing, packing, toxicity
from recordloom.llm.common import discard, release, scratch_dir, stored, table, temporary
from recordloom.llm.labelled import remainder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 5) != 0)
    return toxicity.passing(docs, model).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text."""
    cleaned = linededup.drop_boilerplate(docs, F.col("source"))
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest doc_id."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens by target weights; one epoch, so that no document comes twice."""
    return mixing.mix(docs, budget_share=0.9, max_epochs=1).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: a language model, set similarity and byte-pair ids can't be said in SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage leaves behind is removed once the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch_dir(spark)
        with temporary(spark):
            docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
        before = path
        release(spark)
    return docs
