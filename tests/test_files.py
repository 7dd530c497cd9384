"""Files: compaction of the archive, snapshots, single documents and the followed stream."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stopclock.sources import archive, tables
from stopclock.streaming import positions
from test_archive import line


def cycle(root, day, name, count, vehicle="v"):
    folder = root / f"service_date={day}/cycle=m{name}"
    folder.mkdir(parents=True, exist_ok=True)
    lines = [line(f"{day}T05:{k:02d}:00.000Z", f"{vehicle}{name}", 44.78 + k / 1000, "A") for k in range(count)]
    (folder / f"part-{vehicle}.json.gz").write_bytes(gzip.compress("\n".join([*lines, "{bad", ""]).encode()))


def samples(spark, root):
    return rows(archive.read_collected_positions(spark, str(root)).drop("file_path"))


@pytest.fixture
def root(tmp_path):
    for day in ("2026-07-13", "2026-07-14"):
        for k in range(6):
            cycle(tmp_path / "p", day, f"{k:04d}", 5)
    return tmp_path / "p"


def test_compaction_keeps_all_lines_in_few_files(spark, root):
    before = samples(spark, root)
    days = [dt.date(2026, 7, 13), "2026-07-15"]
    assert archive.compact_days(spark, str(root), days) == ["2026-07-13"]
    assert samples(spark, root) == before and len(before) >= 60
    assert len(list((root / "service_date=2026-07-13").rglob("*.gz"))) == 1 and len(list((root / "service_date=2026-07-14").rglob("*.gz"))) == 6
    assert {r.service_date for r in archive.read_positions(spark, str(root)).collect()} == {dt.date(2026, 7, 13), dt.date(2026, 7, 14)}
    # Again: nothing to do; with a late cycle: the day anew, and in as many files as its size asks for.
    assert archive.compact_days(spark, str(root), days) == []
    cycle(root, "2026-07-13", "9999", 3)
    assert archive.compact_days(spark, str(root), days, file_bytes=100) == ["2026-07-13"]
    assert len(samples(spark, root)) == len(before) + 3
    assert len(list((root / "service_date=2026-07-13").rglob("*.gz"))) > 2


@pytest.mark.parametrize("dies_at", [1, 2, 3])
def test_a_compaction_that_dies_loses_nothing(spark, root, monkeypatch, dies_at):
    """In the copy, between the two renames, and before the old folder is removed."""
    before = samples(spark, root)
    exchange = archive._exchange

    def dying(fs, folder, old, fresh):
        if dies_at >= 2:
            fs.rename(folder, old)
        if dies_at == 3:
            fs.rename(fresh, folder)
        raise RuntimeError("lost")

    monkeypatch.setattr(archive, "_exchange", dying)
    with pytest.raises(RuntimeError, match="lost"):
        archive.compact_days(spark, str(root), ["2026-07-13"])
    monkeypatch.setattr(archive, "_exchange", exchange)
    archive.finish_exchanges(spark, str(root))
    assert samples(spark, root) == before
    archive.compact_days(spark, str(root), ["2026-07-13"])
    assert samples(spark, root) == before
    assert sorted(p.name for p in root.iterdir()) == ["service_date=2026-07-13", "service_date=2026-07-14"]


def test_snapshot_file_is_one_gzipped_array_in_order(spark, tmp_path):
    data = [(3, "C", 1.5, None), (1, "A", None, "x"), (2, "B \"q\"\n", 2.0, "é")]
    table = spark.createDataFrame(data, "pos int, id string, lat double, name string").repartition(3)
    for _ in range(2):  # written again, it is replaced
        archive.write_snapshot(table, str(tmp_path), "2026-07-10", "stops")
    assert [p.name for p in tmp_path.iterdir()] == ["2026-07-10"]
    found = json.loads(gzip.decompress((tmp_path / "2026-07-10/stops.json.gz").read_bytes()))
    assert found == [{"id": "A", "name": "x"}, {"id": 'B "q"\n', "lat": 2.0, "name": "é"}, {"id": "C", "lat": 1.5}]
    assert [(r.id, r.lat) for r in archive.read_stops(spark, str(tmp_path)).orderBy("pos").collect()] == [("A", None), ('B "q"\n', 2.0), ("C", 1.5)]
    archive.write_snapshot(table.limit(0), str(tmp_path), "2026-07-11", "stops")
    assert json.loads(gzip.decompress((tmp_path / "2026-07-11/stops.json.gz").read_bytes())) == []
    assert {str(r.snapshot_date) for r in archive.snapshot_days(spark, str(tmp_path)).collect()} == {"2026-07-10", "2026-07-11"}


def test_documents_are_single_files(spark, tmp_path):
    bodies = {"7": b"%PDF \x00\xff", "12": b"", "doc 3/x": b"text"}
    table = spark.createDataFrame(list(bodies.items()), "doc_id string, body binary")
    for _ in range(2):
        tables.write_documents(table, str(tmp_path / "d"), folders=3)
    found = {r.doc_id: bytes(r.body) for r in tables.read_documents(spark, str(tmp_path / "d/*")).collect()}
    # The digits of "doc%203%2Fx"; Spark passes over files without bytes.
    assert found == {"7": bodies["7"], "2032": b"text"}
    assert sum(p.name == "12" for p in (tmp_path / "d").rglob("*")) == 1
    assert not [p for p in (tmp_path / "d").rglob(".*") if not p.name.endswith(".crc")]


def test_followed_stream_looks_at_open_days_only(spark, tmp_path, monkeypatch):
    root, out, checkpoint = tmp_path / "p", str(tmp_path / "out"), str(tmp_path / "cp")
    listed = []
    stream = positions.position_stream
    monkeypatch.setattr(positions, "position_stream", lambda spark, root, files, days: listed.append(days) or stream(spark, root, files, days))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def follow():
        return positions.follow_positions(spark, str(root), keep, checkpoint, files_per_batch=2)

    assert follow() == []
    for k in range(3):
        cycle(root, "2026-07-13", f"{k:04d}", 5)
    assert follow() == ["2026-07-13"]
    for day in ("2026-07-14", "2026-07-15", "2026-07-16"):
        cycle(root, day, "0000", 5)
    assert follow() == ["2026-07-13", "2026-07-14", "2026-07-15", "2026-07-16"]
    cycle(root, "2026-07-15", "late", 4)
    cycle(root, "2026-07-13", "too-late", 4)
    cycle(root, "2026-07-17", "0000", 5)
    assert follow() == ["2026-07-15", "2026-07-16", "2026-07-17"] == listed[-1]
    assert follow() == ["2026-07-16", "2026-07-17"]
    got = rows(spark.read.parquet(out).drop("file_path", "batch").where("vehicle_id is not null"))
    whole = archive.read_positions(spark, str(root)).where("vehicle_id is not null and vehicle_id != 'vtoo-late'")
    assert got == rows(whole.drop("file_path")) and len(got) == 39


def test_an_interrupted_pass_is_repeated(spark, tmp_path):
    root, out, checkpoint, calls = tmp_path / "p", str(tmp_path / "out"), str(tmp_path / "cp"), []
    for k in range(4):
        cycle(root, f"2026-07-1{k}", "0000", 5)

    def keep(batch, batch_id):
        calls.append(batch_id)
        if len(calls) == 2:
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with pytest.raises(Exception, match="lost"):
        positions.follow_positions(spark, str(root), keep, checkpoint, files_per_batch=1)
    assert len(positions.follow_positions(spark, str(root), keep, checkpoint, files_per_batch=1)) == 4
    (tmp_path / "cp-open-from").write_text("")
    (tmp_path / ".cp-open-from.crc").unlink(missing_ok=True)
    assert len(positions.follow_positions(spark, str(root), keep, checkpoint, files_per_batch=1)) == 4
    assert spark.read.parquet(out).where(F.col("vehicle_id").isNotNull()).count() == 20


def test_large_snapshot_is_several_arrays_in_order(spark, tmp_path):
    table = spark.createDataFrame([(k, f"S{k % 7}", float(k)) for k in range(50)], "pos long, id string, lat double").repartition(5)
    archive.write_snapshot(table, str(tmp_path), "2026-07-10", "stops", entries_per_file=8)
    files = sorted((tmp_path / "2026-07-10/stops").glob("*.json.gz"))
    arrays = [json.loads(gzip.decompress(f.read_bytes())) for f in files]
    assert len(files) > 3 and max(map(len, arrays)) <= 25
    assert [e["lat"] for a in arrays for e in a] == [float(k) for k in range(50)]
    found = archive.read_stops(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.lat for r in found] == [float(k) for k in range(50)] and {str(r.snapshot_date) for r in found} == {"2026-07-10"}
    assert len({r.pos for r in found}) == 50
    # Written again with few entries it is one file, and the folder is gone.
    archive.write_snapshot(table.limit(3), str(tmp_path), "2026-07-10", "stops")
    assert [p.name for p in (tmp_path / "2026-07-10").iterdir() if not p.name.startswith(".")] == ["stops.json.gz"]
    assert archive.read_stops(spark, str(tmp_path), ["2026-07-10"]).count() == 3


def test_lines_of_a_whole_day_are_dealt_to_several_files(spark, tmp_path):
    """One task's lines of one day: a gzip file can't be split among readers."""
    micros = F.lit(1_784_000_000_000) + F.col("id")
    lines = spark.range(20_000).coalesce(1).select(F.lit("2026-07-14T04:00:00.000Z").alias("t"), F.lit("R").alias("r"), F.sha2(F.col("id").cast("string"), 512).alias("n"), micros.alias("ts_ms"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        archive.write_positions(lines, str(tmp_path), whole_days=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list(tmp_path.rglob("*.gz"))
    assert len({f.parent for f in files}) == 1 and len(files) > 1
    assert spark.read.json(str(tmp_path)).select("n").distinct().count() == 20_000
