"""Tables kept in versions, of which one pointer file names the latest.

A version's data are written to a folder of their own under a number that is
claimed first; then the pointer is replaced by a rename.  So readers see the
old version or the new one, never half of either, and a run that dies leaves
what was there.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "latest"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v{version:03d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers that have been claimed, whether or not they were published."""
    jvm, fs = _hadoop(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:-6]) for n in names if n.startswith("v") and n.endswith(".claim") and n[1:-6].isdigit())


def claim(spark: SparkSession, path: str) -> int:
    """The next number, which no other run can get."""
    jvm, fs = _hadoop(spark, path)
    number = max(versions(spark, path), default=0) + 1
    while True:
        at = jvm.org.apache.hadoop.fs.Path(_folder(path, number) + ".claim")
        try:
            fs.create(at, False).close()
            return number
        except Py4JJavaError:
            if not fs.exists(at):
                raise
            number += 1


def point(spark: SparkSession, path: str, version: int) -> None:
    """Make ``version`` the latest: the one step that readers see."""
    jvm, fs = _hadoop(spark, path)
    place = jvm.org.apache.hadoop.fs.Path
    fresh = place(f"{path.rstrip('/')}/.{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, False)
    out.write(bytearray(str(version), "ascii"))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fresh, place(f"{path.rstrip('/')}/{POINTER}"), how)


def latest(spark: SparkSession, path: str) -> int | None:
    """The number that the pointer names; None before the first version."""
    jvm, fs = _hadoop(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    return int(spark.read.text(at.toString()).first()[0]) if fs.exists(at) else None


def publish(df: DataFrame, path: str) -> int:
    """Write ``df`` as the next version of the table at ``path`` and point to it; its number."""
    spark = df.sparkSession
    number = claim(spark, path)
    df.write.mode("errorifexists").parquet(_folder(path, number))
    point(spark, path, number)
    return number


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of the table, the latest if none is named; None if there is none."""
    version = latest(spark, path) if version is None else version
    return None if version is None else spark.read.parquet(_folder(path, version))


def add_urls(spark: SparkSession, path: str, urls: DataFrame) -> int | None:
    """Publish the list at ``path`` with the new ones of ``urls`` (column url).

    The list's rows are (url, version), the version in which each was added.
    Returns the new version's number, None if no url was new: then nothing is
    written.
    """
    held = read(spark, path)
    fresh = urls.select("url").filter("url is not null").distinct()
    if held is not None:
        fresh = fresh.join(held, "url", "left_anti")
    if fresh.isEmpty():
        return None
    number = claim(spark, path)
    rows = fresh.withColumn("version", F.lit(number))
    (rows if held is None else held.unionByName(rows)).write.mode("errorifexists").parquet(_folder(path, number))
    point(spark, path, number)
    return number
