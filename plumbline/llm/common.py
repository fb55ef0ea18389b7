"""Helpers that several operators share: row keys, range buckets over an id,
connected components."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path
from ..shared import written as materialise

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a long column ``name`` that is different in every row.

    The key is the number of the row's file and its place there, so it is the
    same whenever the table is read.  A ``df`` that isn't itself a table of
    files is written first.  Only names of files reach the driver.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        df = materialise(df, "keyed")
    found = df.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    files = df.sparkSession.createDataFrame([(r.f, i) for i, r in enumerate(sorted(found))], "_file string, _number long")
    file, place, number = free_names(df, "_file", "_place", "_number")
    one = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    key = F.shiftleft(number, 40).bitwiseOR(F.col(place))
    return one.join(F.broadcast(files.toDF(file, number)), file).select(*(one[c] for c in df.columns), key.alias(name))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def constants(values: list, kind: str = "bigint") -> Column:
    """An array of numbers as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` ascending cut points of the long column ``key``.

    They are approximate quantiles, so that buckets hold about equal numbers
    of rows; a value that fills several buckets comes as often.  Only the cut
    points reach the driver.
    """
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    got = df.agg(F.percentile_approx(key, constants(shares, "double"), max(10_000, 20 * buckets)).alias("q")).first()
    return sorted(got["q"] or [])


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """Number of cut points below ``key``, by a binary search in one array of
    them; rows with a null key get -1."""
    if not bounds:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("int")
    cuts, n = constants(bounds), len(bounds)

    def halve(lo: Column, step: Column) -> Column:
        at = lo + step
        return F.when((at <= n) & (F.get(cuts, F.least(at, F.lit(n)) - 1) < key), at).otherwise(lo)

    steps = [1 << i for i in range(n.bit_length() - 1, -1, -1)]
    return F.when(key.isNull(), F.lit(-1)).otherwise(F.aggregate(constants(steps, "int"), F.lit(0), halve)).cast("int")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label the nodes of a graph: rows (node, root), root the least node.

    ``edges`` has long columns a and b.  Alternating large-star and small-star
    rounds (Kiveris et al., 2014); every round is a written table, no edge
    reaches the driver, only a count and a checksum do.  Nodes without an edge
    to another node don't occur in the result.
    """
    now = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        now = materialise(_small_star(_large_star(now)), "edges")
    raise RuntimeError("connected components did not converge")
