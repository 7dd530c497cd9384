"""The stored tables: partitioned Parquet, replaced partition by partition (see ``publish``)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stopclock.session import hadoop_path
from stopclock.sources import schemas
from stopclock.sources.publish import Publication, read_published

SCHEMAS = {
    "transit_stop_daily": (schemas.STOP_DAILY, "date"),
    "transit_stop_hourly": (schemas.STOP_HOURLY, "date"),
    "transit_segment_weekly": (schemas.SEGMENT_WEEKLY, "iso_week"),
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns in the order and the types of the stored table."""
    target = StructType.fromDDL(schema)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])


def stage_table(out: Publication, df: DataFrame, name: str, sort_by: list[str], owned: list | None = None) -> None:
    schema, partition = SCHEMAS[name]
    out.stage(conform(df, schema), name, partition, sort_by, owned)


def write_table(df: DataFrame, root: str, name: str, sort_by: list[str], owned: list | None = None) -> None:
    """Replaces the partitions present in ``df``, and all of ``owned``, in one step. Readers see old or new rows; a failed write changes nothing."""
    with Publication(df.sparkSession, root) as out:
        stage_table(out, df, name, sort_by, owned)
        out.commit()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table as last published; one that was never published is empty."""
    return read_published(spark, root, name, SCHEMAS[name][0])


LEDGER_TABLE = "transit_derive_log"


def stage_ledger(out: Publication, rows: DataFrame) -> None:
    """Each job's ledger rows are a partition of their own, so jobs never replace one another's."""
    out.stage(conform(rows, schemas.LEDGER).withColumn("run", F.lit(f"r{out.job}")), LEDGER_TABLE, "run", ["date"])


def append_ledger(rows: DataFrame, root: str) -> None:
    with Publication(rows.sparkSession, root) as out:
        stage_ledger(out, rows)
        out.commit()


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row per derived day, the one processed last; an absent ledger is empty."""
    rows = read_published(spark, root, LEDGER_TABLE, f"{schemas.LEDGER}, run string").drop("run")
    names = [f.name for f in rows.schema if f.name != "date"]
    return (
        rows.groupBy("date").agg(F.max_by(F.struct(*names), "processed_at").alias("last")).select("date", "last.*")
    )


def read_billing_events(reader, path: str) -> DataFrame:
    """Billing events from JSON lines; a batch or a stream reader."""
    return reader.schema(schemas.BILLING_EVENT).json(path)


def write_documents(documents: DataFrame, path: str, folders: int = 64) -> None:
    """One file per document (``doc_id, body``), named by its id, in folders of a hash of the id.

    Spark has no writer of single files, so tasks write through Arrow's file systems; a file appears under its name when it is
    whole, and a task that is run again replaces it.
    """
    spark = documents.sparkSession
    for k in range(folders):
        folder, fs = hadoop_path(spark, f"{path}/{k}")
        fs.mkdirs(folder)
    rows = documents.select(F.col("doc_id").cast("string").alias("name"), F.pmod(F.xxhash64("doc_id"), F.lit(folders)).alias("k"), F.col("body").cast("binary").alias("body"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
        fs, root = pafs.FileSystem.from_uri(uri) if ":" in uri else (pafs.LocalFileSystem(), uri)
        for batch in batches:
            for name, k, body in zip(*(batch.column(c) for c in ("name", "k", "body")), strict=True):
                aside = f"{root}/{k}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(aside) as out:
                    out.write(body.as_buffer() if body.is_valid else b"")
                fs.move(aside, f"{root}/{k}/{quote(name.as_py() or '', safe='')}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, its id from the digits of the file name. Files without bytes are passed over, as Spark does."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(F.regexp_replace(name, r"\D", "").alias("doc_id"), F.col("content").alias("body"))


def export_csv(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").option("header", True).csv(path)


def stop_features(stats: DataFrame, stops: DataFrame) -> DataFrame:
    """Stop results as GeoJSON features, one text line each. Stops without a position have none."""
    names = [c for c in stats.columns if c != "stop_id"]
    placed = stats.join(stops.select("stop_id", "lat", "lon"), "stop_id")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("stop_id", *names).alias("properties"),
    )
    return placed.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def export_geojson(stats: DataFrame, stops: DataFrame, path: str) -> None:
    """One feature per line (GeoJSON text sequence); written by all tasks in parallel."""
    stop_features(stats, stops).write.mode("overwrite").text(path)
