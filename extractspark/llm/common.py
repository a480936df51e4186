"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import shared_dir


#: The folders made inside each ``scratch`` that is open, the innermost last.
_open: list[list[str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/extractspark/{label}-{uuid.uuid4().hex}"
    for made in _open[-1:]:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the folders that were made inside, when it is left: what they fed must have been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop_folder(spark, path)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df below the shared folder and read it again: the lineage ends there."""
    path = path or new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores as it takes to be unlike all others."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


try:
    _give_back = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _give_back = None


def trim() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and what they keep the others lack."""
    pa.default_memory_pool().release_unused()
    if _give_back:
        _give_back(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with its freed memory given back at a task's end."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return ended


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file systems, whatever store holds it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; one aggregate, one row."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts have about ``limit`` bytes; a longer text is alone."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def segments(text: str, size: int) -> Iterator[str]:
    """Runs of about ``size`` characters that end just before a lone space between other characters."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]
