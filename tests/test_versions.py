"""Versions of several tables, SQLite exports, and work on units, with writers that die."""

import os
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from quarryline.sources import stores
from quarryline.sources.versions import Level, Link, OrphanError, Versions, persist
from quarryline.streaming import work

LINKS = (Link("files", "repo", "repos", "id"), Link("fixtures", "file", "files", "id"))


def levels(spark, repos, files, fixtures):
    return [
        Level("repos", spark.createDataFrame(repos, "id int, name string"), ("id",)),
        Level("files", spark.createDataFrame(files, "id int, repo int, path string"), ("id",), "repo", "repos", "id", "num_files"),
        Level("fixtures", spark.createDataFrame(fixtures, "id int, file int, kind string"), ("id",), "file", "files", "id", "num_fixtures"),
    ]


def content(store, version=None):
    return {k: sorted(tuple(r) for r in t.collect()) for k, t in store.tables(version).items()}


def test_nested_rows_become_one_version(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"), LINKS)
    assert store.newest() == 0 and store.tables() == {}
    assert persist(store, levels(spark, [(1, "a"), (2, "b")], [(1, 1, "x"), (2, 1, "y"), (2, 1, "a")], [(1, 2, "k")])) == 1
    first = content(store)
    assert first == {"repos": [(1, "a", 2), (2, "b", 0)], "files": [(1, 1, "x", 0), (2, 1, "y", 1)], "fixtures": [(1, 2, "k")]}
    assert persist(store, levels(spark, [(2, "c")], [(3, 2, "z")], [(1, 1, "m")])) == 2
    assert content(store) == {"repos": [(1, "a", 2), (2, "c", 1)], "files": [(1, 1, "x", 1), (2, 1, "y", 0), (3, 2, "z", 0)], "fixtures": [(1, 1, "m")]}
    assert content(store, 1) == first


def test_an_orphan_makes_no_version(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "s"), LINKS)
    persist(store, levels(spark, [(1, "a")], [(1, 1, "x")], []))
    before = content(store)
    with pytest.raises(OrphanError):
        persist(store, levels(spark, [(5, "e")], [(9, 7, "x")], []))
    with pytest.raises(OrphanError):
        store.change(lambda t: {"repos": t["repos"].limit(0)})
    assert store.newest() == 1 and content(store) == before
    assert len(os.listdir(tmp_path / "s" / "data")) == 1


@pytest.mark.parametrize("step", ["_write", "_check", "_publish"])
def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    store = Versions(spark, str(tmp_path / "s"), LINKS)
    persist(store, levels(spark, [(1, "a")], [(1, 1, "x")], []))
    before = content(store)

    class Killed(BaseException):
        pass

    def die(*a):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(Versions, step, die)
        with pytest.raises(Killed):
            persist(store, levels(spark, [(2, "b")], [], []))
    other = Versions(spark, str(tmp_path / "s"), LINKS)
    assert content(other) == before
    assert persist(other, levels(spark, [(2, "b")], [], [])) == 2
    (tmp_path / "s" / "data" / "left").mkdir()
    assert other.clean(keep=1) >= 2
    assert content(other)["repos"] == [(1, "a", 1), (2, "b", 0)]


def test_rival_writers_both_count(spark, tmp_path):
    errors = []

    def add(k):
        try:
            rows = spark.createDataFrame([(k * 10 + i, f"{k}") for i in range(3)], "id int, name string")
            for i in range(3):
                persist(Versions(spark, str(tmp_path / "s")), [Level("repos", rows.filter(F.col("id") == k * 10 + i), ("id",))])
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = Versions(spark, str(tmp_path / "s"))
    assert not errors and store.newest() == 9
    assert content(store)["repos"] == sorted((k * 10 + i, f"{k}") for k in range(3) for i in range(3))


def test_sqlite_export_comes_back(spark, tmp_path):
    path = str(tmp_path / "x.db")
    rows = [(i, f"n'{i}" if i % 3 else None, i / 4, i % 2 == 0, bytearray(b"\x00a")) for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, `odd \"name\"` string, x double, yes boolean, raw binary").repartition(4)
    stores.write_sqlite({"some table": frame, "none": frame.limit(0)}, path)
    back = stores.read_sqlite(spark, path, "some table")
    assert sorted(tuple(r) for r in back.collect()) == [(*r[:3], int(r[3]), r[4]) for r in rows]
    assert stores.read_sqlite(spark, path, "none").columns == frame.columns and stores.read_sqlite(spark, path, "none").count() == 0
    frame.limit(5).write.format("sqlite_table").mode("append").options(path=path, table="some table").save()
    assert stores.read_sqlite(spark, path, "some table").count() == 105
    frame.limit(5).write.format("sqlite_table").mode("overwrite").options(path=path, table="some table").save()
    assert stores.read_sqlite(spark, path, "some table").count() == 5
    assert sorted(os.listdir(tmp_path)) == ["x.db"]


def test_a_failing_sqlite_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "x.db")
    good = spark.range(10).withColumn("v", F.lit("a"))
    stores.write_sqlite({"t": good}, path)
    bad = spark.range(100).repartition(4).withColumn("v", F.when(F.col("id") == 77, F.raise_error("broken")).otherwise("b"))
    with pytest.raises(Exception, match="broken"):
        stores.write_sqlite({"t": bad, "u": good}, path)
    assert stores.read_sqlite(spark, path, "t").count() == 10
    assert os.listdir(tmp_path) == ["x.db"]


def test_sqlite_reads_views_odd_values_and_tables_without_row_ids(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (a INTEGER, b NUMERIC, c REAL, k TEXT PRIMARY KEY) WITHOUT ROWID")
        c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(1, 2.5, 3, "x"), ("no", 4, 5.5, "y"), (None, None, None, "z")])
        c.execute("CREATE VIEW v AS SELECT k, b FROM t")
    c.close()
    assert sorted(map(str, (tuple(r) for r in stores.read_sqlite(spark, path, "t").collect()))) == sorted(map(str, [("1", 2.5, 3.0, "x"), ("no", 4.0, 5.5, "y"), (None, None, None, "z")]))
    assert stores.read_sqlite(spark, path, "v").count() == 3


RESULT = StructType().add("half", IntegerType()).add("note", StringType())


def run(spark, tmp_path):
    # Tasks can't import the tests, so the function is one of this function's own.
    def halves(row):
        if row["n"] == 7:
            raise ValueError("seven")
        return [{"half": row["n"] // 2, "note": row["tag"]}] * (row["n"] % 3)

    units = spark.readStream.schema("id long, n int, tag string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    work.work_through(units, "id", halves, RESULT, str(tmp_path / "out"), str(tmp_path / "check"), tries=2)
    results, marks = work.outcome(spark, str(tmp_path / "out"), units.schema["id"], RESULT)
    return sorted(map(str, results.collect())), sorted(map(str, marks.collect()))


def units_in(spark, tmp_path, rows):
    spark.createDataFrame(rows, "id long, n int, tag string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_units_are_done_once_and_poison_is_set_aside(spark, tmp_path):
    rows = [(i, i, "a") for i in range(12)] + [(3, 3, "a"), (None, 4, None)]
    units_in(spark, tmp_path, rows)
    units_in(spark, tmp_path, [(5, 500, "again"), (20, 20, "b")])
    results, marks = run(spark, tmp_path)
    assert len(marks) == 14
    assert [m for m in marks if "poison" in m] == ["Row(id=7, status='poison', error='ValueError: seven', tries=2)"]
    assert len(results) == sum(n % 3 for n in [*(i for i in range(12) if i != 7), 4, 20])
    assert run(spark, tmp_path) == (results, marks)


@pytest.mark.parametrize("dies_at", range(1, 6))
def test_a_run_that_died_goes_on(spark, tmp_path, monkeypatch, dies_at):
    units_in(spark, tmp_path, [(i, i, "a") for i in range(9)])
    units_in(spark, tmp_path, [(i, i, "b") for i in range(9, 12)])
    calls = []
    real = work._whole

    def whole(session, folder):
        calls.append(folder)
        if len(calls) == dies_at:
            raise RuntimeError("killed")
        return real(session, folder)

    with monkeypatch.context() as m:
        m.setattr(work, "_whole", whole)
        try:
            run(spark, tmp_path)
        except Exception as e:
            assert "killed" in str(e)
    results, marks = run(spark, tmp_path)
    assert len(marks) == 12 and sum("poison" in m for m in marks) == 1
    assert len(results) == sum(i % 3 for i in range(12) if i != 7)
