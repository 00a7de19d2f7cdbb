"""Global numbers without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """With ``name``: 1, 2, ... in the order, whose ties should be broken.

    Rows are dealt to ranges, numbered in each, and shifted by the rows of the ranges before.  The dealt rows are stored, since
    ranges are drawn from a sample and would differ from run to run.
    """
    held = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    # a row for each range
    counts = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    return held.join(F.broadcast(starts), part == F.col("__part")).withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, name)
