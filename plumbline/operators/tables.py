"""Joins, partitions, ranks and samples over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: base/YYYY/MM/DD, with or without names of the levels.
PARTITION = r"/(?:y=)?(\d{4})/(?:m=)?(\d{2})/(?:d=)?(\d{2})(?:/|$)"


def partitions(files: DataFrame, path: str = "path") -> DataFrame:
    """Partitions of the form base/YYYY/MM/DD and their numbers of files; others are left out."""
    y, m, d = (F.regexp_extract(path, PARTITION, i) for i in (1, 2, 3))
    found = files.filter(F.col(path).rlike(PARTITION)).withColumn("day", F.try_to_date(F.concat_ws("-", y, m, d)))
    return found.filter("day is not null").groupBy("day").agg(F.count("*").alias("files"))


def latest(df: DataFrame, day: str, n: int = 2) -> DataFrame:
    """Rows of the ``n`` newest partitions, with age 1 for the newest."""
    days = df.select(day).distinct().orderBy(F.desc(day)).limit(n)
    ranked = days.withColumn("age", F.row_number().over(Window.orderBy(F.desc(day))))  # n rows
    return df.join(F.broadcast(ranked), day)


def salted_rank(df: DataFrame, group: list[str], key: Column, out: str = "rank", width: int = 2) -> DataFrame:
    """1-based place of each row in its group by ``key``, a hex digest.

    A window runs over the rows of a group that share the digest's first
    ``width`` digits; counts of those parts give what is before them.  So no
    group, however large, is sorted in one task.
    """
    df = df.withColumn("_key", key).withColumn("_part", F.left("_key", F.lit(width)))
    parts = df.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*group))
    parts = parts.withColumn("_before", before).withColumn("_total", total).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_key"))
    out_df = df.withColumn("_in", inside).join(parts, [*group, "_part"])
    return out_df.withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).withColumn("group_size", F.col("_total").cast("long")).drop("_key", "_part", "_before", "_in", "_total")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """column, old and new type and change of two (column, dtype) tables."""
    j = old.withColumnRenamed("dtype", "old").join(new.withColumnRenamed("dtype", "new"), "column", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "type_changed").otherwise("same")
    return j.select("column", "old", "new", change.alias("change"))


def last_before(left: DataFrame, right: DataFrame, ts: str, by: list[str], columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of the same ``by``
    whose time isn't later, or nulls: an as-of join.

    Both sides are one table in the order of (by, time), dealt into ranges.  A
    window finds the last right row inside a range, and the last ones of the
    ranges before give what is carried into it; so there is no join on an
    inequality, and no key, however large, is one task.  Of right rows of one
    time that with the greatest columns counts; a row without a time has no
    last row, and is none.  Columns of ``right`` replace those of ``left`` that
    have their names; null keys match null keys.
    """
    own = [c for c in left.columns if c not in columns]
    value = F.struct(*columns)
    a = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_l"))
    b = right.filter(F.col(ts).isNotNull()).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(ts).alias("_t"), F.lit(0).alias("_side"), value.alias("_r"))
    keys, order = [f"_k{i}" for i in range(len(by))], ["_t", "_side", "_r"]
    both = a.unionByName(b, allowMissingColumns=True)
    dealt = written(both.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "as-of")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row a range and key that has it; null where the range has no right row of the key
    ends = dealt.groupBy(*keys, "_range").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct(*order))).alias("_end"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"_c{c}") for c in keys], F.col("_range").alias("_own"), F.last("_end", ignorenulls=True).over(upto).alias("_carried"))
    found = dealt.withColumn("_in", F.last("_r", ignorenulls=True).over(inside)).filter("_side = 1")
    same = F.col("_range") == F.col("_own")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_c{c}"))
    got = found.join(carried, same, "left").withColumn("_in", F.coalesce("_in", "_carried"))
    return got.select("_l.*", *[F.col("_in")[c].alias(c) for c in columns])


def aligned_counts(base: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Counts of each category on both sides, missing ones 0; one pass over both."""
    both = base.select(F.col(column).alias("value"), F.lit(1).alias("b"), F.lit(0).alias("n")).union(new.select(column, F.lit(0), F.lit(1)))
    return both.filter("value is not null").groupBy("value").agg(F.sum("b").alias("base_n"), F.sum("n").alias("new_n"))


#: Characters of an anchor.
GRAM = 3


def _grams(text: str, size: int) -> Column:
    """The distinct substrings of ``size`` characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    return F.when(F.char_length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _contained(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(file_id, pos, key) of every text ``h`` of ``hay`` that holds a ``needle``.

    Texts meet needles by equality on an anchor, so there is no nested loop:
    that of the needle's substrings of ``GRAM`` characters which the fewest
    texts have.  A text has as many anchors as characters, whatever the
    needles; those it meets are compared.  Shorter needles are their own anchor.
    """
    needles, hay = needles.filter("needle <> ''"), hay.filter("h is not null")
    anchors = hay.select("pos", "key", "h", F.explode(_grams("h", GRAM)).alias("gram"))
    often = anchors.groupBy("gram").agg(F.count("*").alias("n"))
    picked = needles.select("file_id", "needle", F.explode(_grams("needle", GRAM)).alias("gram")).join(often, "gram", "left")
    # a needle of which no text has some anchor is in none
    picked = picked.groupBy("file_id", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).filter("best.n > 0")
    met = picked.select("file_id", "needle", F.col("best.gram").alias("gram")).join(anchors, "gram").filter(F.col("h").contains(F.col("needle"))).select("file_id", "pos", "key")
    few = hay.select("pos", "key", F.explode(F.array_distinct(F.flatten(F.array(*[_grams("h", i) for i in range(1, GRAM)])))).alias("needle"))
    return met.union(needles.filter(F.char_length("needle") < GRAM).join(few, "needle").select("file_id", "pos", "key"))


def cascade(files: DataFrame, meta: DataFrame) -> DataFrame:
    """First metadata row of the first matching strategy for each file.

    ``files`` has file_id and name, ``meta`` has pos, key and path.
    Strategies, in order: (1) the key is the name without extension, (2) the
    name, (3) the former regardless of case, (4) the key contains it
    regardless of case, (5) one of the two starts with the other, (6) the path
    contains the name, (7) the name without extension, regardless of case.
    (That the path's last part is either of these is a case of 6 and 7.)  Each
    works on what the ones before have left, by equi joins.
    """
    left = files.select("file_id", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem")).withColumn("low", F.lower("stem"))
    keys = meta.withColumn("k", F.lower("key"))
    equal = lambda rows, of, key: rows.select("file_id", F.col(of).alias("k")).join(meta.select(key.alias("k"), "pos", "key"), "k").select("file_id", "pos", "key")
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.substring(c, F.lit(1), i))

    def starts(rows):
        rows, own = rows.filter("stem <> ''"), meta.filter("key <> ''")
        down = rows.select("file_id", F.explode(prefixes(F.col("stem"))).alias("key")).join(own, "key").select("file_id", "pos", "key")
        up = rows.select("file_id", F.col("stem").alias("p")).join(own.select("pos", "key", F.explode(prefixes(F.col("key"))).alias("p")), "p").select("file_id", "pos", "key")
        return down.union(up)

    paths = meta.select("pos", "key", F.lower("path").alias("h"))
    steps = [
        lambda r: equal(r, "stem", F.col("key")), lambda r: equal(r, "name", F.col("key")), lambda r: equal(r, "low", F.lower("key")),
        lambda r: _contained(r.select("file_id", F.col("low").alias("needle")), keys.select("pos", "key", F.col("k").alias("h"))), starts,
        lambda r: _contained(r.select("file_id", F.lower("name").alias("needle")), paths), lambda r: _contained(r.select("file_id", F.col("low").alias("needle")), paths),
    ]
    found, rest = None, left
    for i, step in enumerate(steps, 1):
        # what a strategy finds is written, so that the next ones don't work it out again
        best = step(rest).groupBy("file_id").agg(F.min(F.struct("pos", "key")).alias("m"))
        hit = written(best.select("file_id", F.lit(i).alias("strategy"), F.col("m.pos").alias("pos"), F.col("m.key").alias("key")), "cascade")
        found = hit if found is None else found.union(hit)
        rest = rest.join(hit.select("file_id"), "file_id", "left_anti")
    return found
