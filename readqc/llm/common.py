"""Helpers that the corpus operators share: tables in the shared folder, and text batches."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from readqc.session import shared_root

FILE_ROWS = 10_000  # of a staged table that is known to be small


class Workspace:
    """Intermediate tables of one operator run, written to the shared folder, so that a lost executor loses none of
    them and long lineages end there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = itertools.count()
        self._held: list[DataFrame] = []

    def stage(self, df: DataFrame, name: str = "t", rows: int | None = None, **options) -> DataFrame:
        """Write ``df`` (with the writer's ``options``) and read it back. ``rows``: a bound on its rows, if one is known; few
        rows of many partitions go through one more small shuffle to a file for ``FILE_ROWS``, as each file that a task
        opens costs calls to the store (on a local disk without Hadoop's native library, child processes of the executor)."""
        path = f"{self.path}/{name}-{next(self._n)}"
        if rows is not None and (files := max(1, -(-int(rows) // FILE_ROWS))) < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(files)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        self._held.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete staged tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
            path.getFileSystem(conf).delete(path, True)
        self._held = [df for df in self._held if all(df is not x for x in frames)]

    def keep_only(self, *frames: DataFrame) -> None:
        """Delete all staged tables but these."""
        self.drop(*[df for df in self._held if all(df is not x for x in frames)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Plans run meanwhile hand Python workers batches of about ``most`` bytes, not of 10,000 rows whatever their size: Spark
    and the worker each hold one or two of them for every task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(batch: pa.RecordBatch, column: str = "text", chars: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with about ``chars`` bytes of text each (a longer text is a slice of its own), and their texts.
    Texts become Python strings slice by slice, which bounds what a kernel holds beside the batch."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + chars, "right")))
        yield batch.slice(start, stop - start), texts.slice(start, stop - start).to_pylist()
        start = stop


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one the worker gives back what memory it holds, as it lives on for later tasks."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
