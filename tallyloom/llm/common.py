"""Reading tables and cutting lineage."""

from __future__ import annotations

import sys
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tasks that add up what all others have; the driver gets an array from each.
MERGERS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One that is smaller than a split for each core, and lies in fewer files than there are cores, is dealt to all of them; larger ones have splits enough."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and len(df._jdf.inputFiles()) < cores:
        split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split:
            return df.repartition(cores)
    return df


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named in local mode, as in tests."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tallyloom.scratch", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.conf.set("tallyloom.scratch", shared)
    return shared.rstrip("/")


#: For each thread, the scratch tables of the operators that run now, those of the innermost last.
_running = threading.local()


def written(df: DataFrame, name: str, codec: str = "zstd", kept: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost no recomputation. kept: it outlives the innermost released() that it is written in."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = getattr(_running, "scopes", [])
    if len(scopes) > kept:
        scopes[-1 - kept].append(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Deletes the table of a written df that nothing reads any more."""
    _delete(df.sparkSession, df._scratch)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end, except kept ones."""
    if not hasattr(_running, "scopes"):
        _running.scopes = []
    _running.scopes.append([])
    try:
        yield
    finally:
        for path in _running.scopes.pop():
            _delete(spark, path)


def typed(docs: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Only the columns that an operator needs, of the types that it needs; whatever else docs has can't clash."""
    return docs.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns])


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest): rows are told apart by doc_id and digest, so that rows that repeat a doc_id, or have none, are documents of their own."""
    return typed(docs, ("doc_id", "long"), ("text", "string")).withColumn("digest", digest_of())


def bitmap(places: DataFrame, size: int) -> np.ndarray:
    """size booleans: which numbers from 0 to size - 1 are in places (place long). Tasks put their own bits together first, so that what is sent is bounded by size, whatever the table."""
    at = F.col("place") + 1
    rows = places.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(size + (1 << 15), dtype=bool)
    for r in rows:
        out[(r.bucket - 1) << 15 : r.bucket << 15] = np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), bitorder="little")[: 1 << 15]
    return out[:size]


def among(rows: DataFrame, place: str, marks: np.ndarray) -> DataFrame:
    """The rows whose place is marked; filtered where they are read."""
    bits, at = np.packbits(marks).tobytes(), rows.columns.index(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
        for b in batches:
            keep = wanted[np.asarray(b.column(at))]
            if keep.any():
                yield b.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


#: Entries of the map by which rows that a join can't concern are left out of it.
MARKS = 1 << 24


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with their columns as they are, whose doc_id and digest of text are not in gone (doc_id, digest; written).

    gone gives a map of bounded size, which is broadcast; rows that it doesn't
    mark pass where they are read, and the others are joined, so that not all
    texts are dealt because of some.
    """
    place = F.pmod(F.xxhash64("_d"), F.lit(MARKS)) + 1
    own = gone.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d"))
    own = own.withColumn("_p", place)
    maps = own.groupBy(F.bitmap_bucket_number("_p").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))  # MARKS / 2 ** 15 rows of 4 KiB at most
    rows = docs.select(F.struct("*").alias("_row"), F.col("`doc_id`").cast("long").alias("_id"), digest_of("`text`").alias("_d")).withColumn("_p", place)
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = rows.join(F.broadcast(maps), F.bitmap_bucket_number("_p") == F.col("_b"), "left")
    marked = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    free = rows.where(~marked).select("_row")
    held = rows.where(marked).select("_row", F.col("_id"), F.col("_d").alias("_digest"))
    left = held.join(own, held["_digest"].eqNullSafe(own["_d"]) & held["_id"].eqNullSafe(own["_i"]), "left_anti").select("_row")
    return free.unionByName(left).select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def added_up(parts: DataFrame) -> np.ndarray | None:
    """The sum of arrays of doubles of one size, from rows (total binary): first in MERGERS tasks, then here."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0):
                part = np.frombuffer(x.as_buffer(), dtype=float)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    rows = parts.select("total").repartition(MERGERS).mapInArrow(merge, "total binary").collect()
    return sum(np.frombuffer(r.total, dtype=float) for r in rows) if rows else None
