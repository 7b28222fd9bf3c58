"""Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidepost.session import scratch_path, ship_package as ship


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder, and read from there.

    The new table's size is known to the planner, so whether a join may broadcast it is decided by
    its real size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``step`` for ``mapInArrow``, which gives freed memory back to the system at its end.

    Workers outlive their tasks; what they keep for later use would add up over the stages of a long job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; elsewhere nothing is done
        if trim is not None:
            trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
