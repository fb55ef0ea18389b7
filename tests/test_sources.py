"""Versions, partitions and schema catalogues as they are written: crashes, repeats and restarts."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import tables as TB
from plumbline.shared import fresh_path
from plumbline.sources import files as S
from plumbline.sources import schemas as C
from plumbline.sources import versions as V


def local(path):
    return path.removeprefix("file://")


def test_a_version_is_seen_when_the_pointer_moves(spark, monkeypatch):
    path = fresh_path(spark, "versions")
    assert V.latest(spark, path) is None and V.read(spark, path) is None
    assert V.publish(spark.range(3), path) == 1
    assert V.publish(spark.range(5), path) == 2
    with monkeypatch.context() as m, pytest.raises(RuntimeError):  # dies between the data and the pointer
        m.setattr(V, "point", lambda *a: (_ for _ in ()).throw(RuntimeError))
        V.publish(spark.range(9), path)
    assert V.latest(spark, path) == 2 and V.read(spark, path).count() == 5
    # the dead run's number isn't used again
    assert V.publish(spark.range(7), path) == 4
    assert V.read(spark, path).count() == 7 and V.read(spark, path, 1).count() == 3
    assert not [n for n in os.listdir(local(path)) if n.startswith(f".{V.POINTER}-")]


def test_a_run_that_dies_while_it_writes(spark):
    path = fresh_path(spark, "versions")
    V.publish(spark.range(3), path)
    with pytest.raises(Exception):
        V.publish(spark.range(3).select(F.assert_true(F.col("id") < 2)), path)
    assert V.latest(spark, path) == 1 and V.read(spark, path).count() == 3


def test_two_runs_get_two_numbers(spark):
    path = fresh_path(spark, "versions")
    assert [V.claim(spark, path) for _ in range(3)] == [1, 2, 3]
    assert V.versions(spark, path) == [1, 2, 3] and V.latest(spark, path) is None


def test_url_list_is_written_only_when_a_url_is_new(spark):
    path = fresh_path(spark, "urls")
    urls = lambda *u: spark.createDataFrame([(x, 1) for x in u], "url string, version int")
    assert V.add_urls(spark, path, urls()) is None and V.latest(spark, path) is None
    assert V.add_urls(spark, path, urls("a", "b", "a", None)) == 1
    before = sorted(os.listdir(local(path)))
    assert V.add_urls(spark, path, urls("b", "a")) is None
    assert sorted(os.listdir(local(path))) == before
    assert V.add_urls(spark, path, urls("b", "c")) == 2
    assert sorted((r.url, r.version) for r in V.read(spark, path).collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_partitions_written_in_turn_stay(spark):
    path = fresh_path(spark, "partitioned")
    day = lambda *rows: spark.createDataFrame(list(rows), "day date, x int, rows int").withColumn("day", F.col("day").cast("date")) if rows else None
    import datetime as dt

    d = lambda m, n: (dt.date(2024, m, n), m * n, 1)
    S.write_partitions(day(d(1, 1), d(1, 2), d(2, 1)), path, "day", "t")
    S.write_partitions(day(d(3, 1)), path, "day", "t")
    got = S.write_partitions(day(d(1, 9)), path, "day", "t")  # a month once more
    assert sorted((r.y, r.m, r.rows, r.columns) for r in got.collect()) == [(2024, 1, 1, 3), (2024, 2, 1, 3), (2024, 3, 1, 3)]
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [2, 3, 9]
    again = S.write_partitions(day(d(1, 9)), path, "day", "t")
    assert spark.read.parquet(path).count() == 3 and again.count() == 3
    nothing = S.write_partitions(day(d(1, 1)).filter("false"), path, "day", "t")
    assert nothing.count() == 3 and spark.read.parquet(path).count() == 3


def test_schema_history(spark):
    """Columns that are added, removed, retyped, that return, and that return as another type."""
    path = fresh_path(spark, "days")
    days = [
        ("2024-01-01", "id", "id as a", "id as z"), ("2024-01-02", "id", "cast(id as int) a", "'x' b"), ("2024-01-03", "id", "cast(id as int) a"), ("2024-01-04", "id", "1D b", "cast(id as int) a", "id as z"),
    ]
    for d, *cols in days:
        spark.range(10).selectExpr(*cols).coalesce(1).write.parquet(f"{path}/day={d}")
    found = C.catalogue(C.footers(spark, path, 3), "t")
    assert sorted((r.day[-2:], r["column"], r.dtype) for r in found.filter("`column` in ('a', 'b')").collect()) == [
        ("01", "a", "bigint"), ("02", "a", "int"), ("02", "b", "string"), ("03", "a", "int"), ("04", "a", "int"), ("04", "b", "double"),
    ]
    assert {r.rows for r in found.collect()} == {10}
    got = sorted((r.day[-2:], r["column"], r.old, r.new, r.change) for r in C.history(found).collect())
    assert got == [
        ("02", "a", "bigint", "int", "type_changed"), ("02", "b", None, "string", "added"), ("02", "z", "bigint", None, "removed"), ("03", "b", "string", None, "removed"),
        ("04", "b", "string", "double", "returned"), ("04", "z", "bigint", "bigint", "returned"),
    ]
    assert C.history(found.filter("false")).count() == 0


def test_footers_read_no_data_page(spark):
    """The columns are known when all that lies before a file's footer is gone; files that aren't whole are left out."""
    path = fresh_path(spark, "blank")
    spark.range(1000).selectExpr("id", "cast(id as string) s").coalesce(1).write.option("compression", "none").parquet(f"{path}/day=1")
    (name,) = [n for n in os.listdir(local(path) + "/day=1") if n.endswith(".parquet")]
    whole = open(f"{local(path)}/day=1/{name}", "rb").read()
    size = int.from_bytes(whole[-8:-4], "little") + 8
    for n in os.listdir(local(path) + "/day=1"):
        if n.endswith(".crc"):
            os.remove(f"{local(path)}/day=1/{n}")
    with open(f"{local(path)}/day=1/{name}", "wb") as f:
        f.write(whole[:4] + bytes(len(whole) - 4 - size) + whole[-size:])
    os.makedirs(f"{local(path)}/day=2")
    with open(f"{local(path)}/day=2/cut.parquet", "wb") as f:
        f.write(whole[:100])
    got = C.footers(spark, path, 2).collect()
    assert sorted((r["column"], r.dtype, r.rows) for r in got) == [("id", "bigint", 1000), ("s", "string", 1000)]


def test_files_of_one_partition_that_differ(spark):
    path = fresh_path(spark, "mixed")
    spark.range(2).coalesce(1).write.parquet(f"{path}/day=1")
    spark.range(3).selectExpr("cast(id as int) id").coalesce(1).write.mode("append").parquet(f"{path}/day=1")
    (row,) = C.catalogue(C.footers(spark, path), "t").collect()
    assert (row.dtype, row.rows) == ("bigint|int", 5)


def test_schema_diff_of_two(spark):
    a, b = (spark.createDataFrame(x, "column string, dtype string") for x in ([("a", "int"), ("b", "int")], [("b", "long"), ("c", "int")]))
    assert sorted((r["column"], r.change) for r in TB.schema_diff(a, b).collect()) == [("a", "removed"), ("b", "type_changed"), ("c", "added")]
