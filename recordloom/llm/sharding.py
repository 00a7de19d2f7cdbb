"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are rows of equal text.  Each group is placed in the shard where the dot product of its
(bytes, tokens, rows) with the shard's residual capacity is highest, largest groups first.  Groups of more than
``1 / (share * n_shards)`` of all bytes, tokens or rows (so ``3 * share * n_shards`` at most) are placed on the driver.
All others are placed in cells of about ``cell_groups`` by a hash of their text, each by the same rule in a task of its own that
fills its part of what the shards have left.  Since the law is ``bytes``, groups then move from the largest shard to the smallest,
in each cell, while that brings their bytes nearer.

Rows of one text stay together, unless they are more than a shard holds; such a group is cut by a hash of doc_id into pieces
of a shard's size at most (copies of one doc_id stay together, and a piece without a spread of ids may be larger).

Cases: a null text counts as empty (size 1, crc 0); equal or null doc_ids are rows like any other;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, temporary


def place(units: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each unit (rows of shares of bytes, tokens, rows), largest first; ``residual`` (shards x 3) is used up."""
    out = np.zeros(len(units), np.int64)
    for k in np.argsort(-units.max(1, initial=0), kind="stable"):
        out[k] = s = int(np.argmax(residual @ units[k]))
        residual[s] -= units[k]
    return out


def evened(size: np.ndarray, out: np.ndarray, over: np.ndarray, turns: int = 512) -> np.ndarray:
    """Units moved from the shard that is most over its bytes to the one that is least, each time the one nearest to half the difference."""
    over = over + np.bincount(out, size, len(over))
    for _ in range(turns):
        most, least = int(np.argmax(over)), int(np.argmin(over))
        gap = over[most] - over[least]
        fit = np.flatnonzero((out == most) & (size > 0) & (size < gap))
        if not len(fit):
            break
        k = fit[np.argmin(np.abs(2 * size[fit] - gap))]
        out[k] = least
        over[most] -= size[k]
        over[least] += size[k]
    return out


def shard_documents(docs: DataFrame, n_shards: int = 8, share: int = 64, cell_groups: int = 16_384, slot_buckets: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens; law ``bytes``.

    slot numbers a shard's rows from 0 without a gap: rows are numbered inside ``slot_buckets`` hash
    buckets of the shard and shifted by the rows of the buckets before, so no task sorts a shard.
    """
    with temporary(docs.sparkSession):
        return _sharded(docs, n_shards, share, cell_groups, slot_buckets)


def _sharded(docs: DataFrame, n_shards: int, share: int, cell_groups: int, slot_buckets: int) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = stored(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        )
    )
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    totals = np.array([x or 0 for x in base.agg(*sums).head()], float)
    per = np.maximum(totals, 1) / n_shards
    group = ["h", "text_crc32", "size"]
    # groups above a shard's bytes, of which there are fewer than shards, are cut
    cut = base.groupBy(*group).agg(F.sum("size").alias("b")).where(F.col("b") > per[0]).select(*group, F.ceil(F.col("b") / F.lit(float(per[0]))).alias("pieces"))
    split = base.join(F.broadcast(cut), group, "left").withColumn("part", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.col("pieces"))).cast("int")).drop("pieces")
    group = [*group, "part"]
    groups = stored(split.groupBy(*group).agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")))
    scaled = [F.col(c) / F.lit(float(p)) for c, p in zip("btr", per, strict=True)]
    heavy = F.greatest(*scaled) > 1 / share
    # at most 3 * share * n_shards rows
    big = groups.where(heavy).orderBy(*group).collect()
    residual = np.ones((n_shards, 3))
    units = np.array([[u.b, u.t, u.r] for u in big], float).reshape(-1, 3) / per
    at = place(units, residual)
    known = spark.createDataFrame([(u.h, u.text_crc32, u.size, u.part, int(s)) for u, s in zip(big, at, strict=True)], "h long, text_crc32 long, size long, part int, shard int")
    light = groups.where(~heavy)
    count = light.count()
    cells = max(1, round(count / cell_groups))
    left = np.maximum(residual.sum(0), 1e-12)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["h", "text_crc32", "part"], kind="stable")
        own = cell[["b", "t", "r"]].to_numpy(float) / per
        room = residual * (own.sum(0) / left)
        out = evened(own[:, 0].copy(), place(own, room.copy()), -room[:, 0])
        return cell.assign(shard=out.astype("int32"))[["h", "text_crc32", "size", "part", "shard"]]

    placed = light.withColumn("cell", F.pmod(F.xxhash64("h", F.lit("cell")), F.lit(cells))).groupBy("cell").applyInPandas(run, "h long, text_crc32 long, size long, part int, shard int")
    placed = stored(placed.unionByName(known))
    dealt = stored(split.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(slot_buckets))).join(placed, group), outlive=True)
    # n_shards * slot_buckets rows
    before = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = before.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(before), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
