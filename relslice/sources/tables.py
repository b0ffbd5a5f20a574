"""Reading and writing tables of a folder, and staging of intermediate results in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import STAR, Dataset, TableSpec


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_or_none(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """None where the table cannot be read."""
    try:
        return table(spark, folder, name)
    except AnalysisException:
        return None


def dataset(spark: SparkSession, folder: str, specs: dict[str, TableSpec] = STAR, names: Iterable[str] | None = None) -> Dataset:
    """The tables of a folder with their declarations."""
    wanted = {n: specs[n] for n in (names or specs)}
    return Dataset({n: table(spark, folder, n) for n in wanted}, wanted)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Unset, it is an error on a cluster; a local session, whose executors are the driver, gets a folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; staged tables need a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="relslice-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared folder that does not exist yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over four tasks a core, for work that costs much a row on a table of few, large or compressed files."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def staged(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to a new folder of its own and read back; a lost executor then costs one step, not the whole lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with(df: DataFrame, what: Column, name: str = "step") -> tuple[DataFrame, int]:
    """staged(df) and an aggregate of its rows, taken while they are written."""
    seen = Observation()
    out = staged(df.observe(seen, F.coalesce(what, F.lit(0)).alias("n")), name)
    return out, seen.get["n"]


def staged_count(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    return staged_with(df, F.count(F.lit(1)), name)


def write_new(df: DataFrame, folder: str, name: str) -> str:
    """Write a table to a version folder that does not exist yet and return its path; what is being read is never overwritten."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.mode("error").parquet(path)
    return path
