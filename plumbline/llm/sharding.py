"""Contiguous shards of near equal bytes, by DataFrame functions alone.

Rows are put in one order, by the hash of their text, so that equal texts are
neighbours, and dealt into ranges of it.  Each range's total gives the bytes
before it, a running sum inside the range each row's place on the whole line
of bytes, and the line is cut at equal targets.  A cut that would part a group
of equal texts is moved to the group's nearer end, unless the group is too
large for that.  One row per range and one per cut reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialise, with_row_key

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Rows in a range.
RANGE_ROWS = 50_000
#: A group of equal texts of more than this share of a shard may be parted, so that sizes stay near equal.
GROUP_SHARE = 0.05


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", range_rows: int | None = None) -> DataFrame:
    """One row per row: id_col, size, text_crc32, shard, slot.

    Shards 0..shards-1 follow the order of (hash of the text, id).  A row goes
    to the shard in which the middle of its bytes falls, so sizes differ from
    the target by less than a row's size, and ``GROUP_SHARE`` of the target,
    at each end.  slot counts from 0 without gaps in a shard.  A null text has
    no bytes (crc 0) and is a group with the empty ones; rows with a null or
    repeated id are rows like any other.  A single row may be larger than
    several targets; the shards that it covers are then empty.  An empty table
    gives an empty result; other columns are ignored.
    """
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.xxhash64(raw).alias("h"))
    rows = with_row_key(materialise(rows, "sizes"), "row")
    # the row key is last, so that no group, however large, is one range
    order = ["h", "size", "crc", "id", "row"]
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (range_rows or RANGE_ROWS)))
    dealt = materialise(rows.repartitionByRange(ranges, *order).withColumn("bucket", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select("bucket", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "n")])
    w = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("upto", F.sum("size").over(w)).withColumn("nth", F.count("*").over(w)).join(F.broadcast(offsets), "bucket")
    placed = materialise(
        placed.select("id", "size", "crc", "h", (F.col("bytes_before") + F.col("upto")).alias("end"), (F.col("n_before") + F.col("nth") - 1).alias("place")), "placed"
    )
    total = (placed.agg(F.max("end")).first()[0] or 1) / shards
    groups = placed.groupBy("h", "size", "crc").agg(F.min(F.col("end") - F.col("size")).alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n")).filter("n > 1")
    # the groups that a cut parts, as many as cuts at most
    parted = groups.filter((F.floor(F.col("lo") / total) < F.floor(F.col("hi") / total)) & (F.col("hi") - F.col("lo") <= GROUP_SHARE * total)).select("lo", "hi").collect()
    cuts = [total * i for i in range(1, shards)]
    for g in parted:
        cuts = [(g["lo"] if c - g["lo"] < g["hi"] - c else g["hi"]) if g["lo"] < c < g["hi"] else c for c in cuts]
    middle = F.col("end") - F.col("size") / 2
    shard = sum(((middle > float(c)).cast("int") for c in cuts), F.lit(0))
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` as ``path/shard=N``, each of them once.

    Rows are told apart by a key of their own, so null and repeated ids lose
    and multiply nothing; equal texts follow each other in the order of that
    key.  If ``docs`` has a column named shard, the folders are named _shard.
    """
    own, folder, same = free_names(docs, "_row", "shard", "_same")
    keyed = with_row_key(docs, own)
    where = shard_by_bytes(keyed.select(own, text_col), shards, own, text_col).select(F.col(own).alias(same), F.col("shard").alias(folder))
    keyed.join(where, F.col(own) == F.col(same)).drop(own, same).write.partitionBy(folder).parquet(path)
