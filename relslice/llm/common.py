"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import functools
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS_AT_ONCE = 1_000


def small_batches(spark: SparkSession) -> None:
    """Python workers take at most ROWS_AT_ONCE rows at a time, as texts may be long; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def give_back() -> None:
    """Return memory that this Python worker has freed to the system; its allocators would keep it, next to the executor's own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _forget() -> None:
    """Drop the tokenizers that earlier work has left in this worker, which Spark uses again, with all the pieces they remember."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens:
        tokens.forget()
    give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function over batches that needs no tokenizer, in a worker that holds no memory of other work before or after it."""

    @functools.wraps(run)
    def inner(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        yield from run(found)
        give_back()

    return inner


def tidy_groups(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """tidy() of a function over groups."""

    @functools.wraps(run)
    def inner(rows: pd.DataFrame) -> pd.DataFrame:
        _forget()
        out = run(rows)
        give_back()
        return out

    return inner


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, through Spark's own reader.

    Python workers of a local session can then import this package, wherever the session was started; on a cluster the
    package is shipped with --py-files.
    """
    top, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), top]))
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="relslice-"))  # driver and executors are one process
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage. compression: the session's, or
    a codec of Parquet."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)

