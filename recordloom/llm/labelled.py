"""Splits and samples of labelled rows for the classifiers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: at most so many labelled rows are learned from: those with the smallest hashes of their doc_id
SAMPLE = 16_000
#: and of these, in order of the hashes, as many whole texts as have so many characters (one at least)
SAMPLE_CHARS = 100_000_000


def within(rows: Iterable[tuple[str, int]], chars: int = SAMPLE_CHARS) -> Iterator[tuple[str, int]]:
    """The first rows (text, label) that stay within the bound; what one task holds is bounded by it."""
    for k, (text, y) in enumerate(rows):
        chars -= len(text)
        if k and chars < 0:
            return
        yield text, y


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, n: int = SAMPLE) -> DataFrame:
    """text, y of at most n labelled documents for which ``learn`` holds; one task gets them in a fixed order.

    Labels that are null or neither 0 nor 1 are left out, and of several labels of a document the highest counts.
    Only the n chosen ids meet the documents, so texts are not shuffled but for the sample's.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "y", F.xxhash64("doc_id").alias("place")).repartition(1).sortWithinPartitions("place", "text").select("text", "y")
