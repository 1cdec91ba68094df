"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import shared_dir

_CREATED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    _CREATED.append(f"{shared_dir(spark)}/corpusmill-{kind}-{uuid.uuid4().hex}")
    return _CREATED[-1]


def staged(frame: DataFrame, kind: str = "stage") -> DataFrame:
    """Write frame to the shared folder and read it back: cuts lineage, survives lost executors, has known size."""
    path = new_path(frame.sparkSession, kind)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def drop_staged(frame: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    _delete(frame.sparkSession, {f.rsplit("/", 1)[0] for f in frame.inputFiles()})


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this process has staged, archives and packs too. Call it when every result that is needed has been written."""
    _delete(spark, set(_CREATED))
    _CREATED.clear()


def give_back() -> None:
    """Return what this process has freed to the system: a worker outlives its tasks, and allocators keep what they were given."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a task of mapInArrow, giving back the memory that it has freed when it ends."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def _delete(spark: SparkSession, paths: set[str]) -> None:
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
