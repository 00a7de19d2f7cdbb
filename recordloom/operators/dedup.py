"""Order-aware deduplication.  ``order`` is a unique column that stands for the order of input.

Groups are decided by aggregates on narrow rows, summed before the shuffle, so a common key is no task's burden; contents follow by a join on the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_longest(records: DataFrame, order: str, doi: Column, key: Column, abstract: Column, collapse_empty: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Two passes: by doi (else by key), then by the key of what is left.  Columns ``keep`` (all of them) and place.

    In each pass a group keeps the content of its first record of greatest abstract length and the place of its
    first record.  Records of an empty or null key stay apart unless collapse_empty.
    """
    at = F.col(order)
    df = records.select(at.alias("o"), F.coalesce(doi, F.lit("")).alias("doi"), F.coalesce(key, F.lit("")).alias("key"), F.coalesce(F.length(abstract), F.lit(0)).alias("size"), at.alias("place"))
    own = F.concat(F.lit("o:"), F.col("o").cast("string"))
    by_key = F.concat(F.lit("t:"), F.col("key"))
    by_key = by_key if collapse_empty else F.when(F.col("key") == "", own).otherwise(by_key)
    for group in (F.when(F.col("doi") != "", F.concat(F.lit("d:"), F.col("doi"))).otherwise(by_key), by_key):
        best = F.min_by(F.struct("o", "doi", "key", "size"), F.struct(-F.col("size"), F.col("place")))
        df = df.groupBy(group.alias("g")).agg(best.alias("b"), F.min("place").alias("place")).select("b.*", "place")
    kept = df.select(F.col("o").alias(order), "place")
    columns = list(records.columns if keep is None else keep)
    return records.select(order, *(c for c in columns if c != order)).join(kept, order).select(*columns, "place")


def keep_one(records: DataFrame, order: str, key: Column, title: str, source: str | None = None, last: bool = False) -> DataFrame:
    """All records with kept, duplicate_count, duplicate_of_title and, given a source column, the group's sources in order."""
    df = records.withColumn("__k", key)
    chosen, named = (F.max, F.max_by) if last else (F.min, F.min_by)
    groups = df.groupBy("__k").agg(F.count("*").alias("duplicate_count"), named(title, order).alias("duplicate_of_title"), F.min(order).alias("group_order"), chosen(order).alias("__chosen"))
    if source:
        groups = groups.join(grouped(df, order, F.col("__k"), source).select(F.col("key").alias("__s"), "sources"), F.col("__k").eqNullSafe(F.col("__s"))).drop("__s")
    groups = groups.withColumnRenamed("__k", "__g")
    return df.join(groups, F.col("__k").eqNullSafe(F.col("__g"))).withColumn("kept", F.col(order) == F.col("__chosen")).drop("__k", "__g", "__chosen")


def grouped(records: DataFrame, order: str, key: Column, source: str) -> DataFrame:
    """key, first_order, duplicate_count, sources: one row for each group, aggregated before the shuffle."""
    firsts = records.select(key.alias("key"), F.col(order).alias("o"), F.col(source).alias("s")).groupBy("key", "s").agg(F.min("o").alias("o"), F.count("*").alias("n"))
    return firsts.groupBy("key").agg(
        F.min("o").alias("first_order"), F.sum("n").alias("duplicate_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "s"))), lambda x: x["s"]), " | ").alias("sources"))


def first_index(records: DataFrame, order: str, key: Column, value: Column, name: str, last: bool = False) -> DataFrame:
    """key and the first (or last) value that isn't blank: an aggregate, no window."""
    rows = records.select(key.alias("key"), value.alias("v"), F.col(order).alias("o")).where(F.coalesce(F.col("v"), F.lit("")) != "")
    pick = F.max_by if last else F.min_by
    return rows.groupBy("key").agg(pick("v", "o").alias(name))


def routed(records: DataFrame, order: str, title: str, key: Column, keep: Column, reason: Column, last: bool = False) -> DataFrame:
    """All records with ``route``: included or excluded, and duplicates of either side; with __filter_reason, and
    __duplicate_count where a record stands for its group or __duplicate_of_title where it is folded away.  One pass over the records serves all three outputs.
    """
    decided = records.withColumns({"__keep": keep, "__filter_reason": reason})
    marked = keep_one(decided, order, F.concat(F.when(F.col("__keep"), "i:").otherwise("e:"), F.coalesce(key, F.lit(""))), title, last=last)
    side = F.when(F.col("__keep"), "included").otherwise("excluded")
    return marked.select(*records.columns, "__filter_reason", F.when(F.col("kept"), side).otherwise("duplicates").alias("route"), F.when(F.col("kept"), F.col("duplicate_count")).alias("__duplicate_count"), F.when(~F.col("kept"), F.col("duplicate_of_title")).alias("__duplicate_of_title"))


def write_routes(rows: DataFrame, path: str, by: str = "route") -> None:
    """One folder for each value of ``by``, in one job."""
    rows.write.mode("overwrite").partitionBy(by).option("header", True).option("escape", '"').csv(path)
