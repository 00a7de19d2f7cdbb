"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` makes inside without a path are removed at the end, but for those that outlive it: they belong to the context around it, if any."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            discard(spark, path)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Unset, a local session gets a folder of its own; on a cluster that would be a folder of each machine, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/recordloom/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, outlive: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs the tasks that read the table, not those that made it.
    """
    spark = df.sparkSession
    if path is None:
        path = scratch_dir(spark)
        for made in _open[:-1][-1:] if outlive else _open[-1:]:
            made.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder whose readers are done."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans whose results are stored.

    They stay until the driver collects its garbage, which a driver with little to do may not for hours.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
