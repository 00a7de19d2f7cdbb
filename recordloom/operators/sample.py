"""Deterministic samples: rows are ranked by a seeded hash, so any cluster draws the same ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered

SEED = "20261016"


def draw(key: str, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))


def terciles(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """With tercile 0, 1, 2: thirds of the order, the remainder in the last."""
    placed = numbered(rows, order, "__p")
    third = placed.count() // 3
    return placed.withColumn("tercile", F.when(F.col("__p") <= third, 0).when(F.col("__p") <= 2 * third, 1).otherwise(2)).drop("__p")


def stratified(rows: DataFrame, key: str, strata: Sequence[tuple[str, Column, int]], total: int, seed: str = SEED, known: Sequence = ()) -> DataFrame:
    """key, stratum: the known keys first, then strata in order, each of at most its size and of rows that none before has taken; then filled up to ``total``.

    One pass: of each stratum as many rows as can matter (its size, what those before it may take) are ranked before the shuffle and come to the driver.
    """
    sizes = [*strata, ("top-up", F.lit(True), total)]
    most = len(known) + sum(size for _, _, size in sizes)
    in_stratum = F.array_compact(F.array(*(F.when(condition, F.lit(k)) for k, (_, condition, _) in enumerate(sizes))))
    drawn = rows.select(F.col(key), draw(key, seed).alias("__d"), F.explode(in_stratum).alias("__s"))
    place = F.row_number().over(Window.partitionBy("__s").orderBy("__d", key))
    pools: dict[int, list] = {}
    for r in drawn.withColumn("__r", place).where(F.col("__r") <= most).collect():
        pools.setdefault(r["__s"], []).append((r["__r"], r[key]))
    taken = {k: "known item" for k in known}
    for k, (name, _, size) in enumerate(sizes):
        for _, found in sorted(pools.get(k, ()), key=lambda x: x[0]):
            if size <= 0 or len(taken) >= total:
                break
            if found not in taken:
                taken[found] = name
                size -= 1
    return rows.sparkSession.createDataFrame(list(taken.items())[:total], f"`{key}` {rows.schema[key].dataType.simpleString()}, stratum string")


def equal_allocation(rows: DataFrame, key: str, by: str, size: int, seed: str = SEED) -> DataFrame:
    """``size`` rows of each value of ``by``; the planner keeps a group limit before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(draw(key, seed), key))
    return rows.withColumn("draw", place).where(F.col("draw") <= size)
