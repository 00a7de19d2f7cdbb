"""Blocks of vectors, shared by the two vector searches.

Vectors are packed where they are read, up to ``size`` in a block (a row of the table).  A stated set of queries
meets all rows in a grid of cells: candidates are dealt to its columns, queries to its rows.  A cell holds at most about ``CELL`` bytes of
either side, and there are only as many rows as that needs, so while the queries fit a cell each candidate is sent once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, stored

BLOCK = "block long, ids binary, data binary"
FOUND = "query_id long, vec_id long, score {kind}"
CELL = 8 << 20
#: candidates that are looked at together in a cell
CHUNK = 16_384


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id, v (double, or float if it is); not: null ids, vectors null, empty, or with null or non-finite components (or all zero)."""
    v = F.col(vec_col)
    if table.schema[vec_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def blocks(rows: DataFrame, pack: Callable[[np.ndarray], bytes], size: int = 1024) -> DataFrame:
    """One row for up to ``size`` vectors of one length: their ids, and what ``pack`` makes of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}

        def full(ids: list, vectors: list) -> pd.DataFrame:
            return pd.DataFrame({"block": [0], "ids": [np.array(ids, np.int64).tobytes()], "data": [pack(np.array(vectors, np.float64))]})

        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["v"], strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) >= size:
                    yield full(*held.pop(len(v)))
            while len(held) > 1 and sum(len(ids) for ids, _ in held.values()) > 4 * size:  # many lengths
                yield full(*held.pop(next(iter(held))))
        for ids, vectors in held.values():
            yield full(ids, vectors)
        give_back()

    return stored(rows.mapInPandas(run, BLOCK).withColumn("block", F.monotonically_increasing_id()))


def search(queries: DataFrame, candidates: DataFrame, unit: Callable, k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what unit(query blocks, candidate blocks) finds.

    ``unit`` gets two lists of (ids, bytes) and yields arrays (query_id, vec_id, score) that hold each query's k best of the cell.
    """
    spark = queries.sparkSession
    weight = (F.count("*"), F.coalesce(F.sum(F.octet_length("data") + F.octet_length("ids")), F.lit(0)))
    (n_q, b_q), (n_c, b_c) = queries.agg(*weight).head(), candidates.agg(*weight).head()
    if not n_q or not n_c:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    rows, cols = -(-b_q // CELL), max(-(-b_c // CELL), min(n_c, 2 * spark.sparkContext.defaultParallelism))
    # a block's number is its part and its place there: turns from part to part, and in order within one
    dealt = lambda n: F.pmod(F.xxhash64(F.shiftright("block", 33)) + F.col("block").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(n)).cast("int")
    q = queries.select(dealt(rows).alias("r"), "ids", "data").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    c = candidates.select(dealt(cols).alias("s"), "ids", "data").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sides = [[(np.frombuffer(i, np.int64), d) for i, d in zip(side["ids"], side["data"], strict=True)] for side in (left, right)]
        found = list(unit(*sides))
        give_back()
        columns = ("query_id", "vec_id", "score")
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*found, strict=True)), strict=True))) if found else pd.DataFrame({x: [] for x in columns})

    best = q.groupBy("r", "s").cogroup(c.groupBy("r", "s")).applyInPandas(run, FOUND.format(kind=kind))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def chunks(blocks_: list[tuple[np.ndarray, bytes]], rows: int) -> Iterator[list[tuple[np.ndarray, bytes]]]:
    """Blocks in turn, up to ``rows`` vectors at a time (a block at least), so that what a task computes on is bounded."""
    held: list = []
    for block in blocks_:
        if held and sum(len(ids) for ids, _ in held) + len(block[0]) > rows:
            yield held
            held = []
        held.append(block)
    if held:
        yield held


def k_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]
