"""A small table of settings: (key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META_DDL = "key string, value string"


def get(meta: DataFrame, key: str) -> str | None:
    row = meta.where(F.col("key") == key).select("value").first()
    return row.value if row else None


def put(meta: DataFrame, new: DataFrame) -> DataFrame:
    """All settings after ``new`` replaced those of its keys; of several values of a key the largest counts."""
    one = new.groupBy("key").agg(F.max("value").alias("value"))
    return meta.join(one.select("key"), "key", "left_anti").select("key", "value").unionByName(one)


def with_prefix(meta: DataFrame, prefix: str) -> DataFrame:
    return meta.where(F.col("key").startswith(prefix)).orderBy("key")


def clear_prefix(meta: DataFrame, prefix: str) -> DataFrame:
    return meta.where(~F.col("key").startswith(prefix))
