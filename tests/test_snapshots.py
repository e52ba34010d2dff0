"""Snapshot tables: whole changes or none, pinned readers, one winner of two writers, restart of a stream in the middle of a batch."""

import pytest
from pyspark.sql import functions as F

from tidings.sources.snapshots import Conflict, SnapshotTable
from tidings.streaming import streams

SCHEMA = "id long, src string, status string, duplicate_of long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], buckets=4)


def test_insert_keeps_first_of_each_key(spark, table):
    assert table.version() == 0 and table.read().count() == 0
    assert table.insert(rows(spark, [(1, "b", "new", None), (1, "a", "new", None), (2, None, "new", None), (None, "x", "n", None), (None, "y", "n", None)]), [F.col("src")]) == 1
    assert table.insert(rows(spark, [(1, "0", "late", None), (3, "c", "new", None), (None, "x", "n", None)]), [F.col("src")]) == 2
    assert content(table.read()) == sorted([(1, "a", "new", None), (2, None, "new", None), (3, "c", "new", None), (None, "x", "n", None), (None, "y", "n", None), (None, "x", "n", None)], key=str)
    assert content(table.read(1))[:2] == [(1, "a", "new", None), (2, None, "new", None)] and table.read(1).count() == 4
    assert [table.manifest(v)["notes"]["inserted"] for v in (1, 2)] == [4, 2]


def test_change_is_whole_or_nothing(spark, table):
    table.insert(rows(spark, [(k, "s", "new", None) for k in range(200)]), [F.col("id")])
    mark = {"status": F.lit("duplicate"), "duplicate_of": F.col("w.keep")}
    pinned = table.read()
    with pytest.raises(ValueError, match="not found: 900, 901"):
        table.change(spark.createDataFrame([(5, 0), (901, 0), (900, 0)], "id long, keep long"), mark)
    assert table.version() == 1 and table.read().where("status <> 'new'").count() == 0
    table.change(spark.createDataFrame([(5, 0), (6, 1), (6, 1)], "id long, keep long"), mark)
    assert content(table.read().where("status <> 'new'")) == [(5, "s", "duplicate", 0), (6, "s", "duplicate", 1)] and table.read().count() == 200
    assert pinned.where("status = 'new'").count() == 200
    moved = {b for b in table.manifest(2)["buckets"] if table.manifest(2)["buckets"][b] != table.manifest(1)["buckets"][b]}
    assert 1 <= len(moved) <= 2


def test_failing_write_leaves_the_old_version(spark, table, monkeypatch):
    table.insert(rows(spark, [(1, "a", "new", None)]), [F.col("id")])
    bad = rows(spark, [(2, "x", "new", None)]).withColumn("id", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad)
    assert table.version() == 1 and content(table.read()) == [(1, "a", "new", None)]
    monkeypatch.setattr(SnapshotTable, "version", lambda self: 0)
    with pytest.raises(Conflict):
        table.insert(rows(spark, [(7, "z", "new", None)]), [F.col("id")])
    monkeypatch.undo()
    assert content(table.read()) == [(1, "a", "new", None)]


def test_compact_and_vacuum(spark, table):
    for k in range(5):
        table.insert(rows(spark, [(10 * k + j, "s", "new", None) for j in range(10)]), [F.col("id")])
    before = content(table.read())
    table.compact(2)
    assert content(table.read()) == before and all(len(f) == 1 for f in table.manifest()["buckets"].values())
    assert table.vacuum() > 0 and content(table.read()) == before and len(table._listed("_manifests")) == 1


FEED = "id long, src string, at timestamp"


def feed(spark, tmp_path, files):
    for n, data in enumerate(files):
        spark.createDataFrame(data, FEED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


@pytest.mark.parametrize("where", ["before the manifest", "after the manifest"])
def test_stream_stopped_in_a_batch_resumes_exactly_once(spark, tmp_path, monkeypatch, where):
    """The second batch fails once, with its data written but its manifest not, or with both: no row is lost or doubled."""
    import datetime

    at = datetime.datetime(2024, 1, 2)
    files = [[(k, "s", at) for k in range(10 * n, 10 * n + 12)] for n in range(4)] + [[(99, "blocked", at), (98, "s", datetime.datetime(2023, 1, 1)), (97, None, None), (96, "s", at)]]
    source = feed(spark, tmp_path, files)
    table = SnapshotTable(spark, f"file://{tmp_path}/t", FEED, ["id"], buckets=4)
    put, calls = SnapshotTable._put, []

    def breaks(self, version, manifest):
        calls.append(version)
        if where.startswith("after"):
            put(self, version, manifest)
        if len(calls) == 2:
            raise RuntimeError("stopped in the middle")
        if where.startswith("before"):
            put(self, version, manifest)

    monkeypatch.setattr(SnapshotTable, "_put", breaks)

    def start():
        return streams.ingest(source, table, "feed", [F.col("at")], f"{tmp_path}/c", time="at", cutoff="2024-01-01", blocked=F.col("src") == "blocked")

    with pytest.raises(Exception, match="stopped in the middle"):
        start()
    assert table.read().count() in (12, 22)
    start()
    got = table.read()
    assert sorted(r["id"] for r in got.collect()) == [*range(42), 96] and table.version() == 5 and table.manifest()["batches"] == {"feed": 4}
    notes = [table.manifest(v)["notes"] for v in range(1, 6)]
    assert sum(n["fetched"] for n in notes) == 52 and sum(n["inserted"] for n in notes) == 43
    assert sum(n["late"] for n in notes) == 2 and sum(n["blocked"] for n in notes) == 1 and sum(n["wanted"] - n["inserted"] for n in notes) == 6
    start()
    assert table.version() == 5
