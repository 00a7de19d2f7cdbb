"""Shared helpers: scratch tables in the cluster's shared folder, tables by path."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import discard, release, scratch_dir, stored, temporary

__all__ = ["batches_of", "discard", "give_back", "release", "scratch_dir", "spare", "stored", "table", "temporary"]


def spare(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``taken`` has them (in any case of letters)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker stays for the next task, and what it held counts on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of at most ``size`` for the jobs run inside, as 10,000 texts may take any room."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
