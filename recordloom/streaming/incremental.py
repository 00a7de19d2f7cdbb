"""Streams: exclusion of listed titles as records arrive, and an append sink for timing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def exclude_stream(records: DataFrame, key: Column, listed: DataFrame, listed_key: Column) -> DataFrame:
    """A stream-static anti join: blank keys pass, and the list is read again for each batch."""
    side = listed.select(F.nullif(listed_key, F.lit("")).alias("__x")).where("__x is not null").distinct().withColumn("__hit", F.lit(True))
    return records.withColumn("__x", F.nullif(key, F.lit(""))).join(side, "__x", "left").where("__hit is null").drop("__x", "__hit")


def append_rows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch is committed whole, so a crash loses no finished row."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
