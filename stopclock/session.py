"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark broadcasts a join side only while its measured size stays below this;
    # above it the same join is a shuffle join whose hot keys AQE splits.
    "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    # Median buffers are small here, so keep hash aggregation for more groups before sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
}


def build_session(name: str, master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings this library is tuned for."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; in local mode a private one where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="stopclock-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Staging:
    """Intermediate tables of one job in the shared folder, removed when the job ends.

    ``stage`` cuts the lineage with a table that outlives lost executors, and gives the
    optimizer a true file size to decide broadcast joins on.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folder = f"{scratch_root(spark)}/stopclock/job-{uuid.uuid4().hex}"
        #: Labels of the sized tables that are too large for a broadcast.
        self.large: set[str] = set()

    def __enter__(self) -> "Staging":
        return self

    def __exit__(self, *_error) -> None:
        path, fs = hadoop_path(self._spark, self._folder)
        fs.delete(path, True)

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self._folder}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        release_shuffles(self._spark)
        return self._spark.read.schema(df.schema).parquet(path)

    def stage_sized(self, df: DataFrame, label: str, grown: int = 1) -> DataFrame:
        """The same for a table that large tables are joined with; it is broadcast only while its rows in memory are small.

        Files of repeated values are many times smaller than their rows, and the file size alone would have Spark collect
        such a table into the driver. ``grown`` is how much larger than the table its joined form can be.
        """
        staged = self.stage(df, label)
        taken = staged.select(row_bytes(F.struct("*"), staged.schema).alias("n")).agg(F.sum("n")).first()[0] or 0
        limit = self._spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        if taken * grown <= limit:
            return staged
        self.large.add(label)
        return staged.hint("merge")


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner know that shuffle files of finished steps can go; otherwise they lie on disk until the driver is short of memory.

    The first collection only clears the weak references that hold a finished query's plan, the second one finds its shuffles free.
    """
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()


@contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """Within it, tables that are dealt by some of their join keys alike are joined as they lie, not dealt again by all keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def row_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, StructType):
        return sum((row_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, ArrayType):
        each = F.aggregate(value, F.lit(16).cast("long"), lambda s, x: s + row_bytes(x, kind.elementType))
        return F.coalesce(each, F.lit(8).cast("long"))
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    return F.lit(8).cast("long")


def hadoop_path(spark: SparkSession, path: str):
    """A path and the file system it lives on."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def folders_matching(spark: SparkSession, pattern: str, parent: bool = False) -> list:
    """Paths that match a glob, or the folders they lie in."""
    path, fs = hadoop_path(spark, pattern)
    return [s.getPath().getParent() if parent else s.getPath() for s in fs.globStatus(path) or []]


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that Spark gave a stream's checkpoint when it was first used."""
    found = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()
    return found["id"].replace("-", "")


def path_exists(spark: SparkSession, path: str) -> bool:
    found, fs = hadoop_path(spark, path)
    return fs.exists(found)
