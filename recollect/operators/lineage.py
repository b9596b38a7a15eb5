"""Cutting lineage, and small tables of the driver."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where that is unset and all runs on this machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="recollect-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that later plans don't depend on earlier stages or lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def local(spark: SparkSession, columns: dict[str, tuple[list, pa.DataType]]) -> DataFrame:
    """A table of a few rows that the driver has; Spark knows its size."""
    return spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()}))
