"""What several operators of this folder need: input columns, checkpoints, gapless numbers, id filters."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stopclock.session import hadoop_path, scratch_root

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: Stands for a null id inside the operators: it counts as smaller than every other id.
NO_ID = -(1 << 63)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_back(column: Column) -> Column:
    return F.when(column != NO_ID, column)


def give_back() -> None:
    """Returns to the system what this process has freed; a worker that Spark uses again would keep it beside all later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most about ``BATCH_BYTES``, so that long texts don't fill a worker.

    The limit is a setting of the session and stays set; one that is lower already is kept. Workers serve many tasks, so
    memory that earlier tasks have freed is given back before a task, and its own after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from function(batches)
        give_back()

    conf = df.sparkSession.conf
    now = re.fullmatch(r"(-?\d+)b?", conf.get(BATCH_SETTING))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder, which outlive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession))
        removed_at_exit(df.sparkSession, context.getCheckpointDir())
    return df.checkpoint(eager=True)


def removed_at_exit(spark: SparkSession, folder: str) -> str:
    """The folder, to be deleted when the driver ends: results that read it are lazy, so it can't go earlier."""
    path, fs = hadoop_path(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


class Scratch:
    """Tables between the steps of one operator, written to the shared folder and deleted when their last reader is done.

    A table cuts the lineage and outlives lost executors like a checkpoint, is compressed, and has a known size. What a
    lazy result still reads stays until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._count = spark, 0
        self._folder = removed_at_exit(spark, output_folder(spark, name))
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{self._count}"
        self._count += 1
        df.write.parquet(path)
        found = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(found)] = path
        return found

    def keep_small(self, df: DataFrame) -> DataFrame:
        """The same as a checkpoint, which is written and read faster where there is little in many partitions."""
        found = checkpointed(df)
        self._paths[id(found)] = found._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables, and lets Spark's cleaner know that shuffle files of finished steps can go."""
        for table in tables:
            path, fs = hadoop_path(self._spark, self._paths.pop(id(table)))
            fs.delete(path, True)
        self._spark.sparkContext._jvm.System.gc()


def plain_names(df: DataFrame) -> DataFrame:
    """The columns as ``c0``, ``c1``, …, so that none clashes with a column an operator adds."""
    return df.select(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(df.columns)])


def own_names(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``plain_names`` under their own names, others dropped."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def numbered(df: DataFrame, within: list[str], order: list[str], name: str, blocks: int = 256) -> DataFrame:
    """Adds ``name``: numbers from 0 without gaps inside each value of ``within``, in an order fixed by the data.

    No task sorts a whole value: rows are dealt to ``blocks`` by a hash of ``order``, a block is numbered
    by itself and starts where the earlier blocks end. Numbers follow ``(block, order)``. ``df`` is read twice, so it
    should be narrow or checkpointed.
    """
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    key = [*within, "_block"]
    ahead = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    )
    same = F.lit(True)
    for i, c in enumerate(key):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return (
        df.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
        .join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_row") - 1)
        .drop("_block", "_row", "_start", *[f"_k{i}" for i in range(len(key))])
    )


def key_bits(keys: DataFrame, columns: list[str], bits: int = 22) -> DataFrame:
    """A bitmap of hashed keys as a table of at most ``2**(bits - 6)`` rows, for any number of keys.

    It only spares work: rows whose bit is unset are certainly not among ``keys``, the others still have to be joined.
    """
    at = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    mask = F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))"))
    return checkpointed(keys.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(mask.alias("_mask")).coalesce(8))


def split_by_bits(df: DataFrame, columns: list[str], bitmap: DataFrame, bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """Rows that may be among the keys of a bitmap, and those that are not. The bitmap, of bounded size, is broadcast."""
    at = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    hit = (F.shiftright(at, 6) == F.col("_word")) & (F.expr("shiftright(_mask, cast(_at & 63 as int)) & 1") == 1)
    marked = df.withColumn("_at", at)
    small = F.broadcast(bitmap)
    return marked.join(small, hit, "left_semi").drop("_at"), marked.join(small, hit, "left_anti").drop("_at")


def output_folder(spark: SparkSession, name: str) -> str:
    """A new folder for an operator's files beside the checkpoints, which driver and executors share."""
    return f"{scratch_root(spark).rstrip('/')}/stopclock/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, as tasks see it; a path without a scheme is local, and S3 may be written ``s3a``."""
    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri))
    return pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)
