"""Pairs of a Spark query and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Registry(dict):
    """name: Registered; filled by the decorator that query() returns."""

    def query(self, sql: str | None = None, name: str | None = None):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            key = name or f.__name__
            if key in self:
                raise ValueError(f"{key} is registered already")
            self[key] = Registered(f, sql)
            return f

        return add


#: Tables of long texts.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One of long texts that is smaller than a split for each core, and lies in fewer files than there are cores, is dealt to all of them; larger ones have splits enough."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and len(df._jdf.inputFiles()) < cores:
        split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split:
            return df.repartition(cores)
    return df
