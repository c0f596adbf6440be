"""Committed tables and files: whatever dies, and whenever, readers see one whole version."""

import os
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from marketloom.sources import readers, text_files, writers
from marketloom.sources.versions import Conflict, Files, Table
from marketloom.streaming import incremental

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_readers_see_whole_versions_while_writers_write(spark, tmp_path):
    table, seen, done = Table(spark, str(tmp_path / "t")), [], threading.Event()
    assert table.read() is None and table.current() is None
    table.replace(spark.range(0, 100).repartition(4))

    def look():
        while not done.is_set():
            rows = ids(Table(spark, str(tmp_path / "t")).read())
            seen.append((rows[0] // 100, len(rows), rows[-1] - rows[0]))

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(1, 6):
        table.replace(spark.range(100 * n, 100 * n + 100).repartition(4))
    done.set()
    reader.join()
    assert {(count, width) for _, count, width in seen} == {(100, 99)} and [n for n, _, _ in seen] == sorted(n for n, _, _ in seen)
    assert ids(table.read(table.version(2)))[0] == 100
    table.replace(table.read().filter("id % 2 = 0"))  # reads what it replaces
    assert table.read().count() == 50


def test_a_failure_at_any_step_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = Table(spark, path)
    table.replace(spark.range(10))

    def broken(*_):
        raise OSError("gone")

    def fails(x):
        raise ValueError("a task died")

    with pytest.raises(Exception, match="a task died"):
        table.replace(spark.range(5).withColumn("id", F.udf(fails, "long")("id")))
    assert ids(Table(spark, path).read()) == list(range(10))
    for step in ("create", "publish"):
        with monkeypatch.context() as m:
            m.setattr(Files, step, broken)
            with pytest.raises(OSError):
                table.replace(spark.range(5))
        assert ids(Table(spark, path).read()) == list(range(10))
    assert len([n for n in os.listdir(path) if n.startswith("d-")]) > 1
    assert table.vacuum() == [] and len(table.vacuum(grace=0)) >= 2
    assert len([n for n in os.listdir(path) if n.startswith("d-")]) == 1 and ids(table.read()) == list(range(10))


def test_a_killed_driver_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    Table(spark, path).replace(spark.range(10))
    dies = f"""
import os
from pyspark.sql import SparkSession
from marketloom.sources.versions import Files, Table
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
Files.publish = lambda self, name, text: os.kill(os.getpid(), 9)
Table(spark, {path!r}).replace(spark.range(3))
"""
    ended = subprocess.run([sys.executable, "-c", dies], cwd=REPO, capture_output=True, timeout=120)
    assert ended.returncode == -9 and len([n for n in os.listdir(path) if n.startswith("d-")]) == 2
    table = Table(spark, path)
    assert ids(table.read()) == list(range(10))
    table.replace(spark.range(7))
    assert ids(table.read()) == list(range(7))


def test_of_two_writers_one_is_told(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    first = table.replace(spark.range(1))
    table.commit(spark.range(2), first)
    with pytest.raises(Conflict):
        table.commit(spark.range(3), first)
    assert ids(table.read()) == [0, 1] and table.change(lambda old: old.unionByName(spark.range(5, 6))).number == 3 and ids(table.read()) == [0, 1, 5]


def test_split_tables_change_by_part(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), split="day")
    rows = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-02"), (3, None), (4, "a/b é"), (5, "")], "id long, day string")
    first = table.replace(rows)
    assert len(first.parts) == 5 and sorted(map(tuple, table.read().fillna("~").collect())) == sorted(map(tuple, rows.fillna("~").collect()))
    assert ids(table.read(labels=["v2026-01-02"]).select("id")) == [2]
    second = table.commit(spark.createDataFrame([(9, None)], "id long, day string"), first, ["null", "v2026-01-01"])
    assert ids(table.read().select("id")) == [2, 4, 5, 9] and second.parts["v2026-01-02"] == first.parts["v2026-01-02"]
    with pytest.raises(ValueError, match="aren't replaced"):
        table.commit(spark.createDataFrame([(9, "")], "id long, day string"), second, ["null"])
    assert ids(table.commit(rows.limit(0), second, list(second.parts)) and table.read().select("id")) == []


def test_a_batch_is_merged_once(spark, tmp_path, monkeypatch):
    """Killed before its commit a batch leaves nothing; replayed after it, it changes nothing."""
    landing, target, checkpoint = (str(tmp_path / x) for x in ("landing", "target", "checkpoint"))
    schema = "k string, v long"
    run = lambda: incremental.merge_stream(spark, landing, schema, target, ["k"], checkpoint, mode="upsert").awaitTermination()
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(landing)
    run()
    spark.createDataFrame([("a", 9), ("c", 3)], schema).write.mode("append").parquet(landing)
    table = Table(spark, target)
    with monkeypatch.context() as m:
        m.setattr(Files, "publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(Exception):
            run()
    assert table.current().number == 1 and sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 2)]
    run()
    now = table.current()
    assert now.number == 2 and sorted(map(tuple, table.read().collect())) == [("a", 9), ("b", 2), ("c", 3)]
    os.remove(f"{checkpoint}/commits/1")  # the driver died after the table's commit, before the stream's own
    if os.path.exists(f"{checkpoint}/commits/.1.crc"):
        os.remove(f"{checkpoint}/commits/.1.crc")
    run()
    assert table.current() == now
    assert not incremental.merge_batch(table, spark.createDataFrame([("z", 0)], schema), 1, incremental.stream_id(spark, checkpoint), ["k"])


def test_updates_are_flushed_by_count(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.replace(spark.range(130).select(F.concat(F.lit("u"), F.format_string("%03d", "id")).alias("url"), F.lit("").alias("content")))
    fetched = table.read().select("url", F.when(F.substring("url", 4, 1) != "7", F.concat(F.lit("text of "), "url")).alias("content"))
    assert incremental.flush_updates(fetched, table, ["url"], "content", every=50) == 3 and table.current().number == 4
    assert table.read().filter("content = ''").count() == 13  # failed for now
    assert incremental.flush_updates(fetched.limit(0), table, ["url"], "content") == 0


def test_files_are_committed_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "files")
    first = spark.createDataFrame([("news/2026-01/a b+%41.txt", "ä\n"), ("report/y.txt", ""), ("z.txt", None)], "path string, value string")
    text_files.write(first.repartition(3), folder)
    assert sorted(map(tuple, text_files.read(spark, folder).collect())) == [("news/2026-01/a b+%41.txt", "ä\n"), ("report/y.txt", ""), ("z.txt", "")]

    def fails(x):
        if x == "z.txt":
            raise ValueError("a task died")
        return x

    with pytest.raises(Exception, match="a task died"):
        text_files.write(first.repartition(3).withColumn("path", F.udf(fails, "string")("path")), folder)
    with pytest.raises(Exception, match="leaves"):
        text_files.write(spark.createDataFrame([("../../out.txt", "x")], "path string, value string"), folder)
    # A task that was still at it when its job was aborted may leave files; no version names them.
    Table(spark, folder).vacuum(grace=0)
    assert len([n for n in os.listdir(folder) if n.startswith("d-")]) == 1 and text_files.read(spark, folder).count() == 3
    text_files.write(spark.createDataFrame([("report/y.txt", "new"), ("more.txt", "m")], "path string, value string"), folder)
    assert dict(map(tuple, text_files.read(spark, folder).collect())) == {"news/2026-01/a b+%41.txt": "ä\n", "report/y.txt": "new", "z.txt": "", "more.txt": "m"}
    text_files.write(first.limit(1), folder, mode="overwrite")
    assert text_files.read(spark, folder).count() == 1 and text_files.read(spark, str(tmp_path / "none")).count() == 0
    text_files.write(first.limit(0), folder, mode="overwrite")
    assert text_files.read(spark, folder).count() == 0


def test_files_that_a_later_commit_replaces_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "files")
    files = lambda rows: spark.createDataFrame(rows, "path string, value string")
    text_files.write(files([(f"n/{k}.txt", "" if k % 3 else f"old {k}") for k in range(40)]), folder)
    (first,) = [n for n in os.listdir(folder) if n.startswith("d-")]
    text_files.write(files([(f"n/{k}.txt", f"new {k}") for k in range(20)]), folder)
    for k in range(20):  # a reader that opened these would fail
        os.remove(f"{folder}/{first}/n/{k}.txt")
        os.symlink(f"{folder}/nowhere", f"{folder}/{first}/n/{k}.txt")
    found = text_files.read(spark, folder)
    assert dict(map(tuple, found.collect())) == {f"n/{k}.txt": f"new {k}" if k < 20 else "" if k % 3 else f"old {k}" for k in range(40)}
    text_files.write(files([("n/a.txt.gz", "no archive")]), folder)
    assert text_files.read(spark, folder).filter("path = 'n/a.txt.gz'").first()["value"] == "no archive"
    assert "max_by" not in found._jdf.queryExecution().toString()


def test_the_last_line_of_several_result_files_wins(spark, tmp_path):
    line = lambda i, text: '{"custom_id":"%s","response":{"status_code":200,"body":{"choices":[{"message":{"content":"%s"}}]}}}\n' % (i, text)
    (tmp_path / "part-1").write_text(line("a", "first") + line("b", "of the first file"))
    (tmp_path / "part-2").write_text("".join(line(f"x{i}", "filler " * 20) for i in range(5000)) + line("a", "early") + line("a", "last"))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = dict(map(tuple, readers.read_results(spark, str(tmp_path)).collect()))
            assert got["a"] == "last" and got["b"] == "of the first file" and len(got) == 5002
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_master_tables_read_their_old_version_while_written(spark, tmp_path):
    path = str(tmp_path / "news")
    (tmp_path / "plain.csv").write_text('url,symbol,title,date\nu9,1,"a ""b""",2026-01-01\n')
    assert readers.read_master(spark, str(tmp_path / "plain.csv"), "news").first()["title"] == 'a "b"'
    writers.init_master(spark, path, "news")
    assert readers.read_master(spark, path, "news").count() == 0
    writers.write_master(readers.read_master(spark, str(tmp_path / "plain.csv"), "news"), path, "news")
    assert [r["url"] for r in readers.read_master(spark, path, "news").collect()] == ["u9"]
