"""Helpers shared by the corpus operators: staged tables, Arrow batches, shared files, cuts of a key range."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import scratch, stage  # noqa: F401  (re-exported)

#: Rows and bytes in one Arrow batch, so that a task holds a bounded piece of text besides its longest one.
BATCH_ROWS = "512"
BATCH_BYTES = str(2 << 20)
#: Bytes of a row group of staged tables; a task that writes texts holds one.
ROW_GROUP = str(16 << 20)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches and row groups small; texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("parquet.block.size", ROW_GROUP)


def release() -> None:
    """Give memory that is free back to the system; a Python worker outlives its tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same work on batches, with free memory given back when its task ends."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return work


def map_columns(df: DataFrame, work: Callable, schema: str, per_task: bool = False) -> DataFrame:
    """Apply `work` to each Arrow batch as a dict of Python lists (numpy arrays may come back).

    With `per_task` it is called once in each task and returns the function; what that remembers ends with the task."""
    small_batches(df.sparkSession)
    types = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, apply = to_arrow_schema(types), work() if per_task else work
        for batch in batches:
            out = apply({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            arrays = [pa.array(out[field.name], type=field.type) for field in target]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(tidy(run), types)


def keep_rows(df: DataFrame, columns: list[str], good: Callable, per_task: bool = False) -> DataFrame:
    """The rows, whole, for which `good` (given those columns of a batch as lists) says so."""
    small_batches(df.sparkSession)
    types = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = good() if per_task else good
        for batch in batches:
            yield batch.filter(pa.array(apply(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in columns)), pa.bool_()))

    return df.mapInArrow(tidy(run), types)


def without(df: DataFrame, key: str, gone: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows whose key is not in `gone`; a null key stays. Up to `most` keys are sent to all tasks, so texts do not
    travel; more are joined by a shuffle."""
    gone = stage(gone.select(F.col(key).alias("_gone")).distinct(), "gone")
    few = gone.limit(most + 1).count() <= most
    return df.join(F.broadcast(gone) if few else gone, F.col(key) == F.col("_gone"), "left_anti")


def filesystem(path: str):
    """(pyarrow file system, path in it) of a folder all executors reach."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class SharedFile:
    """A new file in a shared folder. Each attempt of a task writes a name of its own, and readers learn names
    only from the rows of tasks that ended well, so a lost or repeated task leaves no half file in use."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.out, self.position = self.fs.open_output_stream(f"{root}/{self.name}", compression=None), 0

    def write(self, data: bytes) -> int:
        """Append; gives the offset at which the data starts."""
        start = self.position
        self.out.write(data)
        self.position += len(data)
        return start

    def close(self) -> None:
        self.out.close()


def open_shared(folder: str, name: str):
    fs, root = filesystem(folder)
    return fs.open_input_file(f"{root}/{name}")


def cuts_of(df: DataFrame, key: str, rows_per_range: int, most: int = 4096) -> list[int]:
    """Ascending cut values that split the non-null integers of `key` into ranges of about equal row counts.

    The ranges follow the number of rows; `most` bounds what is sent to the tasks, beyond it ranges grow.
    """
    rows = df.agg(F.count(key)).first()[0]
    n = min(most, max(1, -(-rows // rows_per_range)))
    if n == 1:
        return []
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted(set(found))


def range_of(key: Column, cuts: list[int]) -> Column:
    """Number of the range that holds a key: how many cuts lie at or below it; null belongs to the first."""
    if not cuts:
        return F.lit(0)
    below = F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= key)
    return F.when(key.isNull(), 0).otherwise(F.size(below))
