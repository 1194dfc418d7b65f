"""Shared-folder materialisation and small session helpers for the operators of this subpackage.

Everything that outlives one Spark job goes to the folder the cluster names in
``spark.checkpoint.dir``: it is shared by driver and executors, so a lost executor costs a
re-read and nothing else.  A folder of our own is used only where that setting is absent
(plain local sessions and tests).
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kept import shared_folder


class Work:
    """A private subfolder of the shared folder: ``put`` writes a table and reads it back."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later job reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)


def utf8(text: Column | str) -> Column:
    """UTF-8 bytes of a string column; null counts as empty."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def parts_for(total_bytes: int, each: int = 16 << 20, least: int = 1) -> int:
    return max(least, -(-int(total_bytes or 0) // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of a partition; at its end a worker, which is used again, gives free memory back."""

    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return out
