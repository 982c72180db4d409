"""Versioned tables: touched files only, one whole version at any moment, plain folders taken over."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stepwise.sources import versions as V
from tests.conftest import rows


@pytest.fixture
def folder(spark, tmp_path):
    """400 rows in 8 files of 50 consecutive keys; a null key in the last."""
    path = str(tmp_path / "table with space")
    df = spark.range(400).selectExpr("nullif(id, 399) as k", "concat('v', id) as v", "if(id % 5 = 0, null, cast(id as double)) as x")
    df.repartitionByRange(8, F.coalesce("k", F.lit(399))).write.parquet(path)
    return path


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in map(str, Path(path).rglob("*.parquet"))}


def listed(spark, path):
    return set(V.current(spark, path)[2])


def test_delete_rewrites_touched_files_only(spark, folder):
    before, names = files(folder), listed(spark, folder)
    assert V.delete_rows(spark, folder, [3, 4, 120, 9999, None], "k") == 1
    after = files(folder)
    assert all(after[p] == t for p, t in before.items())  # nothing that was there has changed
    kept = names & listed(spark, folder)
    assert len(names) == 8 and len(kept) == 6
    got = V.read_version(spark, folder)
    assert got.count() == 397 and got.where("k in (3, 4, 120)").count() == 0 and got.where("k is null").count() == 1
    assert spark.read.parquet(folder).count() == 400  # plain readers see the folder as it was


def test_replace_and_merge(spark, folder):
    new = spark.createDataFrame([(7, "new", 1.0), (7, "new2", 2.0)], "k int, v string, x double")
    assert V.replace_rows(spark, folder, new, "k", keys=[7, 8]) == 1
    assert rows(V.read_version(spark, folder).where("k between 6 and 9")) == [(6, "v6", 6.0), (7, "new", 1.0), (7, "new2", 2.0), (9, "v9", 9.0)]
    names = listed(spark, folder)
    source = spark.createDataFrame([(10, "10.5"), (11, "1"), (151, "5"), (300, "bad")], "k long, data string")
    num = F.col("s.data").try_cast("double")
    # 151 has a value and 300 no number: only the first file can change, and 300's is looked at
    assert V.merge_rows(spark, folder, source, "k", {"x": num}, F.col("t.x").isNull() & num.isNotNull(), among=F.col("x").isNull()) == 2
    got = V.read_version(spark, folder)
    assert rows(got.where("k in (10, 11, 151, 300)"), "k", "x") == [(10, 10.5), (11, 11.0), (151, 151.0), (300, None)]
    assert got.count() == 400 and len(names - listed(spark, folder)) == 2
    with pytest.raises(Exception, match="several source rows"):
        V.merge_rows(spark, folder, source.union(source), "k", {"x": num})
    assert V.current(spark, folder)[0] == 2


def test_nothing_to_do_makes_no_version(spark, folder):
    assert V.delete_rows(spark, folder, [], "k") == V.delete_rows(spark, folder, [5000], "k") == 0
    assert V.read_version(spark, folder).count() == 400


def test_a_writer_that_stops_leaves_the_version_before(spark, folder, monkeypatch):
    table = V.read_version(spark, folder)
    with monkeypatch.context() as m:
        m.setattr(V, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):  # new files are there, their list isn't
            V.replace_table(table.withColumn("v", F.lit("half")), folder)
    assert rows(V.read_version(spark, folder)) == rows(table)
    # a list that was begun and not finished is passed over, and its number isn't used again
    os.makedirs(f"{folder}/_versions", exist_ok=True)
    Path(f"{folder}/_versions/00000001").write_text(table.schema.json() + "\n")
    assert rows(V.read_version(spark, folder)) == rows(table)
    assert V.replace_table(V.read_version(spark, folder).selectExpr("k", "k * 2 as w"), folder) == 2
    got = V.read_version(spark, folder)
    assert got.columns == ["k", "w"] and got.count() == 400 and got.where("w != 2 * k").count() == 0


def test_two_writers_one_wins(spark, folder, monkeypatch):
    real = V._write_files

    def slow(df, path):
        written = real(df, path)
        with monkeypatch.context() as m:
            m.setattr(V, "_write_files", real)
            V.delete_rows(spark, folder, [1], "k")  # another writer commits meanwhile
        return written

    monkeypatch.setattr(V, "_write_files", slow)
    with pytest.raises(V.TableChanged):
        V.delete_rows(spark, folder, [2], "k")
    assert V.read_version(spark, folder).where("k in (1, 2)").count() == 1


def test_old_files_are_dropped_on_request(spark, folder):
    for k in (1, 51, 101):
        V.delete_rows(spark, folder, [k], "k")
    want = rows(V.read_version(spark, folder))
    assert V.drop_unreferenced(spark, folder, keep=2) == 2
    assert V.drop_unreferenced(spark, folder) == 1
    assert rows(V.read_version(spark, folder)) == want and len(files(folder)) == 8


def test_partitioned_folders_are_refused_and_new_tables_made(spark, tmp_path):
    spark.range(4).withColumn("d", F.col("id") % 2).write.partitionBy("d").parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="partitioned"):
        V.delete_rows(spark, str(tmp_path / "p"), [1], "id")
    assert V.replace_table(spark.range(3), str(tmp_path / "n")) == 1
    assert V.delete_rows(spark, str(tmp_path / "n"), [0, 1, 2], "id") == 2 and V.read_version(spark, str(tmp_path / "n")).count() == 0
