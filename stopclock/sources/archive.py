"""The position archive: dated folders of gzipped JSON lines, and dated network snapshots."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopclock.functions.calendar import (
    LOCAL_OFFSET_HOURS, bad_clock_entries, epoch_ms, from_epoch_ms, in_service_hours, iso_text, local_hour, local_key_parts,
)
from stopclock.session import hadoop_path, path_exists
from stopclock.sources import schemas
from stopclock.sources.publish import Publication, read_published

# A day's folder is named by its date alone, or as Spark names partitions; collection cycles lie below it.
_FOLDER_DATE = r"/(?:service_date=)?(\d{4}-\d{2}-\d{2})/(?:cycle=[^/]+/)?[^/]*$"
_DATE_GLOB = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]"


def folder_date(path: Column) -> Column:
    """Date of the folder a file lies in: the service day, whatever its rows say."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(path, _FOLDER_DATE, 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def day_paths(root: str, days: list[dt.date | str] | None) -> list[str]:
    """Only the folders asked for are listed."""
    return [f"{root}/{{,service_date=}}{day}/{{,cycle=*/}}*.gz" for day in days or [_DATE_GLOB]]


def present_days(spark: SparkSession, root: str, days: list[dt.date | str]) -> list[str]:
    """Those of the days that have a folder in the archive."""
    return [str(d) for d in days if path_exists(spark, f"{root}/{d}") or path_exists(spark, f"{root}/service_date={d}")]


def position_lines(reader, paths: list[str] | str) -> DataFrame:
    """Parsed archive lines; blank and malformed lines are dropped. Works on batch and stream readers."""
    return reader.schema(schemas.POSITION_LINE).option("mode", "DROPMALFORMED").json(paths)


def project_positions(lines: DataFrame) -> DataFrame:
    """Archive lines to samples. An unreadable time becomes null and is rejected with the invalid samples."""
    return lines.select(
        folder_date(F.col("_metadata.file_path")).alias("service_date"),
        F.col("_metadata.file_path").alias("file_path"),
        epoch_ms(F.try_to_timestamp("t")).alias("ts_ms"),
        F.col("v.vehicleId").alias("vehicle_id"),
        F.col("r").alias("route_id"),
        F.col("p").alias("pattern_suffix"),
        F.col("v.lat").alias("lat"),
        F.col("v.lon").alias("lon"),
        F.col("v.nextStopId").alias("next_stop_id"),
    )


def read_positions(spark: SparkSession, root: str, days: list[dt.date | str] | None = None) -> DataFrame:
    """Samples of the given service days, or of every archived day."""
    return project_positions(position_lines(spark.read, day_paths(root, days)))


def archived_files(spark: SparkSession, root: str, days: list[dt.date | str] | None = None) -> DataFrame:
    """``service_date, file_path`` of archive objects; contents are not read."""
    files = spark.read.format("binaryFile").load(day_paths(root, days)).select("path")
    return files.select(folder_date(F.col("path")).alias("service_date"), F.col("path").alias("file_path"))


def archived_days(spark: SparkSession, root: str) -> DataFrame:
    """``service_date`` of the archive's day folders; only folder names are listed."""
    path, fs = hadoop_path(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    days = sorted({n.removeprefix("service_date=") for n in names})
    listed = spark.createDataFrame([(d,) for d in days], "d string")
    return listed.select(F.try_to_timestamp("d", F.lit("yyyy-MM-dd")).cast("date").alias("service_date")).where("service_date is not null")


def snapshot_days(spark: SparkSession, root: str) -> DataFrame:
    return archived_days(spark, root).withColumnRenamed("service_date", "snapshot_date")


def _snapshot_rows(spark: SparkSession, root: str, name: str, schema: str, dates) -> DataFrame:
    """Entries of dated JSON arrays, with their place in the snapshot.

    Each file is one JSON array and is read by one task; a large snapshot is a folder of numbered files. The position is the file's
    number and the order of reading within that file.
    """
    folders = [str(d) for d in dates] if dates else [_DATE_GLOB]
    rows = spark.read.schema(schema).option("multiLine", True).json([f"{root}/{f}/{name}{{,/*}}.json.gz" for f in folders])
    path = F.col("_metadata.file_path")
    number = F.coalesce(F.nullif(F.regexp_extract(path, rf"/{name}/(\d+)\.json\.gz$", 1), F.lit("")).cast("long"), F.lit(0))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumns({
        "snapshot_date": folder_date(F.regexp_replace(path, f"/{name}/([^/]*)$", "/$1")), "pos": F.shiftleft(number, 33) + within,
    })


def read_stops(spark: SparkSession, root: str, dates: list[dt.date | str] | None = None) -> DataFrame:
    """snapshot_date, pos, id, lat, lon, name."""
    return _snapshot_rows(spark, root, "stops", schemas.STOP, dates)


def read_routes(spark: SparkSession, root: str, dates: list[dt.date | str] | None = None) -> DataFrame:
    """Routes with details, both snapshot generations brought to one shape.

    snapshot_date, pos, id, patterns, sched_fwd, sched_rev, poly_fwd, poly_rev. A generation without
    directions describes the forward one.
    """
    rows = _snapshot_rows(spark, root, "routes", schemas.ROUTE, dates).where(F.col("detail").isNotNull())
    single_schedule = F.when(F.col("schedule.fwd").isNull(), F.col("schedule.weekdaySchedules"))
    single_line = F.when(F.col("polyline.fwd").isNull(), F.col("polyline.encodedValue"))
    return rows.select(
        "snapshot_date", "pos", "id",
        F.col("detail.patterns").alias("patterns"),
        F.coalesce(F.col("schedule.fwd.weekdaySchedules"), single_schedule).alias("sched_fwd"),
        F.col("schedule.rev.weekdaySchedules").alias("sched_rev"),
        F.coalesce(F.col("polyline.fwd.encodedValue"), single_line).alias("poly_fwd"),
        F.col("polyline.rev.encodedValue").alias("poly_rev"),
    )


def write_snapshot(rows: DataFrame, root: str, day: dt.date | str, name: str, position: str = "pos", entries_per_file: int = 20_000) -> None:
    """Writes rows as the gzipped JSON array ``root/day/name.json.gz``, in the order of ``position``, replacing what is there.

    An array is written and read by one task, so a snapshot of more than ``entries_per_file`` entries becomes a folder
    ``root/day/name`` of about so large arrays, numbered in that order. What is written appears under its name when it is
    whole. Null fields are left out.
    """
    spark = rows.sparkSession
    entries = rows.count()
    files = max(1, -(-entries // entries_per_file))
    dealt = rows.repartitionByRange(files, position) if files > 1 else rows
    entry = F.to_json(F.struct(*[c for c in rows.columns if c != position]))
    number = F.spark_partition_id() if files > 1 else F.lit(0)
    inside = Window.partitionBy("file").orderBy("at")
    first, last = F.row_number().over(inside) == 1, F.lead(F.lit(1)).over(inside).isNull()
    lines = dealt.select(number.alias("file"), F.col(position).cast("long").alias("at"), entry.alias("entry")).select(
        "file", F.concat(F.when(first, "[").otherwise(","), "entry", F.when(last, "]").otherwise("")).alias("value")
    )
    if not entries:
        lines = spark.createDataFrame([(0, "[]")], "file int, value string")
    aside, fs = hadoop_path(spark, f"{root}/.{day}-{name}-{uuid.uuid4().hex}")
    lines.write.partitionBy("file").option("compression", "gzip").text(str(aside))
    whole, _ = hadoop_path(spark, f"{aside}/whole")
    fs.mkdirs(whole)
    for status in fs.globStatus(hadoop_path(spark, f"{aside}/file=*/part-*")[0]):
        part = status.getPath()
        _rename(fs, part, hadoop_path(spark, f"{whole}/{int(part.getParent().getName().removeprefix('file=')):06d}.json.gz")[0])
    single, folder = (hadoop_path(spark, f"{root}/{day}/{name}{end}")[0] for end in (".json.gz", ""))
    fs.mkdirs(single.getParent())
    fs.delete(single, False)
    fs.delete(folder, True)
    _rename(fs, whole if files > 1 else hadoop_path(spark, f"{whole}/000000.json.gz")[0], folder if files > 1 else single)
    fs.delete(aside, True)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{target} could not be written")


def timetable_faults(routes: DataFrame) -> DataFrame:
    """``snapshot_date, id, entries, bad``: timetable entries of a route and how many of them are no clock times."""
    blocks = F.concat(*[F.coalesce(c, F.array().cast(routes.schema["sched_fwd"].dataType)) for c in ("sched_fwd", "sched_rev")])
    texts = routes.select("snapshot_date", "id", F.explode(blocks).alias("b")).select("snapshot_date", "id", F.explode("b.stops.arrivalTimes").alias("text"))
    listed = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), ","), lambda t: F.trim(t) != ""))
    return texts.groupBy("snapshot_date", "id").agg(F.sum(listed).alias("entries"), F.sum(F.coalesce(bad_clock_entries(F.col("text")), F.lit(0))).alias("bad"))


def routes_with_patterns(catalog: DataFrame) -> DataFrame:
    """Catalogue routes (``id, short_name, suffixes``) with at least one non-empty pattern suffix."""
    kept = F.filter("suffixes", lambda s: F.coalesce(s != "", F.lit(False)))
    return catalog.withColumn("suffixes", kept).where(F.size("suffixes") > 0)


def flatten_replies(replies: DataFrame) -> DataFrame:
    """One collection cycle's replies (suffix to vehicles) to one archive line per vehicle.

    ``replies``: route_id, short_name, sampled_at, reply. The vehicle object is kept as it came.
    """
    by_suffix = replies.select("route_id", "short_name", "sampled_at", F.explode("reply").alias("p", "vehicles"))
    return by_suffix.select(
        iso_text(F.col("sampled_at")).alias("t"),
        F.col("route_id").alias("r"),
        F.col("short_name").alias("n"),
        "p",
        F.explode("vehicles").alias("v"),
        epoch_ms(F.col("sampled_at")).alias("ts_ms"),
    )


#: Parts of a whole day's lines, which the adaptive planner puts together to files.
_DAY_FILES = 64


def write_positions(
    lines: DataFrame, root: str, offset_hours: int = LOCAL_OFFSET_HOURS, writer: str | None = None, whole_days: bool = False
) -> None:
    """Archives collected lines under their local date and ``HHMM``, the key of a collection cycle.

    Lines outside service hours are not collected; nothing to collect writes no rows. Writing a cycle again
    replaces just that cycle. A cycle that several writers fill in parts, as the batches of a stream do, has
    one folder per ``writer``, and each replaces its own only. ``whole_days`` is for loading an archive: each
    local date is one cycle, which spares a folder per minute. A gzip file is written and read by one task, so the lines of
    a whole day are dealt to several.
    """
    day, minute = local_key_parts(F.col("ts_ms"), offset_hours)
    minute = F.lit("all") if whole_days else minute
    cycle = minute if writer is None else F.concat(minute, F.lit(f"-{writer}"))
    kept = lines.where(in_service_hours(local_hour(F.col("ts_ms"), offset_hours)))
    dealt = F.pmod(F.xxhash64("ts_ms"), F.lit(_DAY_FILES)) if whole_days else F.lit(0)
    (
        # The letter keeps the name from being read back as a number.
        kept.withColumn("service_date", day).withColumn("cycle", F.concat(F.lit("m"), cycle))
        .withColumn("_dealt", dealt).hint("rebalance", F.col("service_date"), F.col("cycle"), F.col("_dealt")).drop("ts_ms", "_dealt")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("service_date", "cycle").option("compression", "gzip").json(root)
    )


def compact_days(spark: SparkSession, root: str, days: list[dt.date | str], file_bytes: int = 128 << 20) -> list[str]:
    """Replaces the cycles of closed days by few files of about ``file_bytes``, and returns the days that were replaced.

    A day of two-minute cycles and several writers is thousands of small gzip files, which cost more to list and open than
    to read. Lines are copied as they are into a new folder beside the day's; then the folders are exchanged by two renames. A
    job that dies before loses nothing, and one that dies between the renames leaves the old folder under a name that
    tells the day: the next call, or :func:`finish_exchanges`, completes it. A day that is compacted already stays as it is.
    """
    finish_exchanges(spark, root)
    done = []
    for day in days:
        folder, fs = hadoop_path(spark, f"{root}/service_date={day}")
        if not fs.exists(folder):
            continue
        cycles = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
        if not cycles or all(c == _COMPACTED for c in cycles):
            continue
        fresh, _ = hadoop_path(spark, f"{root}/.new-{day}-{uuid.uuid4().hex}")
        files = max(1, -(-fs.getContentSummary(folder).getLength() // file_bytes))
        lines = spark.read.schema("value string").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).text(str(folder))
        lines.repartition(files).write.option("compression", "gzip").text(f"{fresh}/{_COMPACTED}")
        old, _ = hadoop_path(spark, f"{root}/.old-{day}-{fresh.getName().rsplit('-', 1)[1]}")
        _exchange(fs, folder, old, fresh)
        done.append(str(day))
    return done


_COMPACTED = "cycle=compacted"


def _exchange(fs, folder, old, fresh) -> None:
    if fs.exists(folder) and not fs.exists(old):
        fs.rename(folder, old)
    if fs.exists(fresh) and not fs.rename(fresh, folder):
        raise OSError(f"{folder} could not be replaced")
    fs.delete(old, True)


def finish_exchanges(spark: SparkSession, root: str) -> None:
    """Completes exchanges that a compaction left half done, and removes folders of compactions that never came so far."""
    pattern, fs = hadoop_path(spark, f"{root}/.old-*")
    for status in fs.globStatus(pattern) or []:
        day, mark = status.getPath().getName().removeprefix(".old-").rsplit("-", 1)
        _exchange(fs, hadoop_path(spark, f"{root}/service_date={day}")[0], status.getPath(), hadoop_path(spark, f"{root}/.new-{day}-{mark}")[0])
    for status in fs.globStatus(hadoop_path(spark, f"{root}/.new-*")[0]) or []:
        fs.delete(status.getPath(), True)


def read_collected_positions(spark: SparkSession, root: str) -> DataFrame:
    """Samples written by :func:`write_positions`; the service day is the partition."""
    lines = spark.read.schema(schemas.POSITION_LINE + ", service_date date").option(
        "mode", "DROPMALFORMED"
    ).json(root)
    return lines.select(
        "service_date",
        F.col("_metadata.file_path").alias("file_path"),
        epoch_ms(F.try_to_timestamp("t")).alias("ts_ms"),
        F.col("v.vehicleId").alias("vehicle_id"), F.col("r").alias("route_id"), F.col("p").alias("pattern_suffix"),
        F.col("v.lat").alias("lat"), F.col("v.lon").alias("lon"), F.col("v.nextStopId").alias("next_stop_id"),
    )


ARRIVALS_ARCHIVE = "arrivals_archive"


def stage_arrivals_archive(out: Publication, arrivals: DataFrame, owned: list | None = None) -> None:
    """Arrivals as gzipped JSON lines per service day, instants as ISO text cut to milliseconds.

    Days of ``owned`` without arrivals become empty.
    """
    stamp = iso_text(from_epoch_ms(F.col("ts_ms")))
    lines = arrivals.select(
        "service_date", F.col("stop_id").alias("stop"), F.col("route_id").alias("route"),
        F.col("direction").alias("dir"), stamp.alias("ts"), F.col("delay_s").alias("delay"),
    )
    out.stage(lines, ARRIVALS_ARCHIVE, "service_date", [], owned, "json", compression="gzip", ignoreNullFields="false")


def read_arrivals_archive(spark: SparkSession, root: str) -> DataFrame:
    return read_published(spark, root, ARRIVALS_ARCHIVE, schemas.ARRIVAL_LINE + ", service_date date", "json")
