"""Streams: what batches do by runs, as they come in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import versions


class Refused(Exception):
    """The receiver of a batch has refused it."""


def delta_stream(source: DataFrame, state_path: str, checkpoint: str, key: str, stamp: str, accept: Callable[[DataFrame], bool]) -> StreamingQuery:
    """Each batch's latest stamps that the state lacks go to accept(); the state, a Parquet table, advances only where that says yes.

    A refusal ends the query with an error and leaves the batch uncommitted, so
    that the same checkpoint offers its rows again. State files are named by
    checkpoint and batch: a batch that is repeated writes its own file anew,
    and another checkpoint, whose batches are numbered from 0 again, writes others.
    """
    run = _name_of(checkpoint)

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        latest = rows.groupBy(key).agg(F.max(stamp).alias(stamp))
        own = f"run-{run}-batch-{number}"
        try:
            state = spark.read.parquet(f"{state_path}/*").where(~F.col("_metadata.file_path").contains(f"/{own}/")).groupBy(key).agg(F.max(stamp).alias(stamp))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            state = latest.limit(0)
        new = versions.delta(latest, state, key, stamp).persist()
        try:
            if not accept(new):
                raise Refused(f"batch {number}")
            new.write.mode("overwrite").parquet(f"{state_path}/{own}")
        finally:
            new.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _name_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def compacted(spark: SparkSession, state_path: str, key: str, stamp: str, to: str) -> None:
    """The state of state_path as one file for each task in the new folder to; no stream may write meanwhile."""
    spark.read.parquet(f"{state_path}/*").groupBy(key).agg(F.max(stamp).alias(stamp)).write.parquet(f"{to}/run-compacted-batch-0")


def windowed_counts(events: DataFrame, ts: str, kind: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and kind with a watermark; an addition of this library."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), kind).agg(F.count("*").alias("n"))


def file_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
