"""Shared helpers: the shared work folder, written intermediate tables, tokenizer files."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``; only a session in one process may go without."""
    return shared_folder(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and fixes the rows: what follows no longer depends on a
    recomputation after a lost executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{re.sub(r'[^a-z0-9_]', '_', name.lower())}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(made: DataFrame) -> None:
    """Delete a table that ``written`` gave, once no query reads it any more."""
    jvm, sc = made.sparkSession._jvm, made.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in made.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of each query go when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def common_from(counted: DataFrame, most: int, n: str = "n") -> int:
    """The least count that at most ``most`` rows reach, from a few hundred classes of counts."""
    size = F.when(F.col(n) < 64, F.col(n).cast("double")).otherwise(F.pow(2.0, F.floor(F.log2(n) * 8) / 8))
    classes = counted.groupBy(size.alias("at")).agg(F.count("*").alias("rows")).collect()
    least, total = None, 0
    for at, rows in sorted(classes, reverse=True):
        total += rows
        if total > most:
            break
        least = at
    return 1 << 62 if least is None else int(np.ceil(least))


def few_or_shuffled(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` as the small side of a join: marked for a broadcast only if its rows, a few numbers each, are counted to be few."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def only_ids(df: DataFrame, ids: DataFrame, col: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose ``col`` is in ``ids``; the ids are broadcast only if they are counted to be few."""
    return df.join(few_or_shuffled(ids), col, "left_semi")


def give_back() -> None:
    """Hand memory that this process has freed back to its machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which Spark keeps, gives back what it has freed."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def text_blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of the text in ``column``, one row at least."""
    for batch in batches:
        octets = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(octets, octets[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def strings(column: pa.Array) -> list:
    """The values as Python strings, by way of numpy, which is many times faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; ``folder`` overrides the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
