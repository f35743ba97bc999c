"""Shared pieces of the training-data operators: shared storage and bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or the context's checkpoint folder
    where the setting is absent. Without either a single-machine session gets a temporary one, and
    any other is refused: executors elsewhere couldn't see a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkveil-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope that deletes, when it's left, the tables that operators wrote to the shared folder within it.
    Write the result elsewhere before: what operators return reads these tables."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        discard(spark, *made)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sparkveil-{name}-{uuid.uuid4().hex}"
    for made in _scopes.get()[-1:]:
        made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `materialize`, with the path, for `discard`."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that later ones have replaced; none that a result still reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns called c0, c1, ... and the new name of each: so no name in `df`, dotted or equal
    to one of an operator's own, matters inside the operator."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), {c: f"c{i}" for i, c in enumerate(df.columns)}


def sliced(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 1 << 20, max_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `max_bytes` of `column` (one long text alone may
    be more) and at most `max_rows` rows. Between batches Arrow gives unused memory back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + max_bytes, side="right"))
            stop = min(max(stop, start + 1), start + max_rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is read as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
