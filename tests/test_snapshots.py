"""Tables replaced in one step: readers stay with a version, writers notice each other."""

import threading

import pytest
from pyspark.sql import functions as F

from undercroft.sources import snapshots, tables


def numbers(spark, version, n=50):
    return spark.range(n).select("id", F.lit(version).alias("version"))


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(numbers(spark, 0), path)
    plain = tables.read_table(spark, path)
    tables.replace_table(numbers(spark, 1, 20), path)
    first = tables.read_table(spark, path)
    tables.replace_table(first.withColumn("version", F.lit(2)), path)
    assert plain.select("version").distinct().collect() == [(0,)] and plain.count() == 50
    assert first.select("version").distinct().collect() == [(1,)] and first.count() == 20
    assert tables.read_table(spark, path).select("version").distinct().collect() == [(2,)]
    for i in range(3, 7):
        tables.replace_table(numbers(spark, i), path)
    assert snapshots.versions(spark, path) == [4, 5, 6]
    assert snapshots.child_names(spark, path) == [snapshots.VERSIONS]
    assert not [n for n in snapshots.child_names(spark, f"{path}/{snapshots.VERSIONS}") if n.startswith(".draft")]


def test_reading_while_a_job_replaces(spark, tmp_path):
    path, seen, problems = str(tmp_path / "t"), set(), []
    tables.replace_table(numbers(spark, 0), path)
    done = threading.Event()

    def read():
        while not done.is_set():
            try:
                found = {tuple(r) for r in tables.read_table(spark, path).groupBy("version").count().collect()}
                if len(found) != 1 or next(iter(found))[1] != 50:
                    problems.append(found)
                seen.update(v for v, _ in found)
            except Exception as error:  # noqa: BLE001
                problems.append(error)
    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 8):
        tables.replace_table(numbers(spark, i), path)
    done.set()
    reader.join(60)
    assert not problems and len(seen) > 1


def test_the_second_of_two_writers_fails_and_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(numbers(spark, 1), path)

    def slow(draft):
        tables.replace_table(numbers(spark, 2), path)
        tables.write_table(numbers(spark, 3), draft)
    with pytest.raises(snapshots.ReplacedByAnother):
        snapshots.publish(spark, path, slow)
    assert tables.read_table(spark, path).select("version").distinct().collect() == [(2,)]
    assert snapshots.child_names(spark, f"{path}/{snapshots.VERSIONS}") == ["v000000001", "v000000002"]


def test_a_write_that_breaks_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(numbers(spark, 1), path)
    with pytest.raises(Exception, match="broken"):
        tables.replace_table(numbers(spark, 2).withColumn("x", F.raise_error(F.lit("broken"))), path)
    assert tables.read_table(spark, path).select("version").distinct().collect() == [(1,)]
    tables.write_table(numbers(spark, 9), path)
    assert tables.read_table(spark, path).select("version").distinct().collect() == [(9,)]


def test_small_files_appear_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "m" / "1.json")
    snapshots.write_text(spark, path, "äöü" * 1000)
    assert snapshots.read_text(spark, path) == "äöü" * 1000
    with pytest.raises(snapshots.ReplacedByAnother):
        snapshots.write_text(spark, path, "other")
    assert snapshots.child_names(spark, str(tmp_path / "m" / "none")) == []
