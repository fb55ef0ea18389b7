"""A catalogue of the columns that written partitions have, and its history."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import list_files

_FOOTER = "path string, rows long, `column` string, dtype string"
#: Name of the entry of a Parquet footer in which Spark keeps a file's schema.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def _footer(path: str) -> tuple[int, list[tuple[str, str]]]:
    """Rows and (column, dtype) of a Parquet file; no data page is read."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        meta = pq.read_metadata(f)
    own = (meta.metadata or {}).get(SPARK_SCHEMA)
    if own:
        return meta.num_rows, [(f.name, f.dataType.simpleString()) for f in StructType.fromJson(json.loads(own))]
    return meta.num_rows, [(f.name, str(f.type)) for f in meta.schema.to_arrow_schema()]


def footers(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """(path, rows, column, dtype) of every Parquet file under ``path``, read file by file in tasks.

    A file that isn't Parquet, or is cut off, is left out.
    """

    def run(batches):
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                try:
                    rows, columns = _footer(p)
                except (pa.ArrowInvalid, OSError):
                    continue
                out += [(p, rows, c, kind) for c, kind in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "rows", "column", "dtype"])

    files = list_files(spark, path, "*.parquet").select("path")
    return files.repartition(tasks or 4 * spark.sparkContext.defaultParallelism).mapInArrow(run, _FOOTER)


def catalogue(found: DataFrame, dataset: str, day: str = r"/day=([^/]+)/") -> DataFrame:
    """(dataset, day, column, dtype, rows) of ``footers``: a row for each column
    of each partition, the partition's name cut from the paths by the pattern
    ``day``.  Where the files of a partition differ, dtype has all types.

    ``rows`` counts the rows of the files that have the column.
    """
    part = found.withColumn("day", F.regexp_extract("path", day, 1)).filter("day <> ''")
    kinds = F.array_join(F.sort_array(F.collect_set("dtype")), "|")  # few types a column
    return part.groupBy("day", "column").agg(kinds.alias("dtype"), F.sum("rows").alias("rows")).select(F.lit(dataset).alias("dataset"), "day", "column", "dtype", "rows")


def history(found: DataFrame) -> DataFrame:
    """(dataset, day, column, old, new, change) of a catalogue: what each
    partition changes against the one before it.

    change is added, removed, returned (after partitions without it; old is
    the type that it had) or type_changed.  A dataset's first partition
    changes nothing.
    """
    days = found.select("dataset", "day").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("dataset").orderBy("day")))  # a row a partition
    own = Window.partitionBy("dataset", "column").orderBy("nth")
    seen = found.join(days, ["dataset", "day"]).select(
        "dataset", "column", "nth", "dtype", F.lag("nth").over(own).alias("last"), F.lag("dtype").over(own).alias("old"), F.lead("nth").over(own).alias("next")
    )
    entry = lambda at, old, new, change: F.struct(at.alias("nth"), old.alias("old"), new.alias("new"), F.lit(change).alias("change"))
    none, nth = F.lit(None).cast("string"), F.col("nth")
    changes = F.array_compact(F.array(
        F.when(F.col("last").isNull() & (nth > 1), entry(nth, none, F.col("dtype"), "added")),
        F.when(F.col("last") < nth - 1, entry(nth, F.col("old"), F.col("dtype"), "returned")),
        F.when((F.col("last") == nth - 1) & (F.col("old") != F.col("dtype")), entry(nth, F.col("old"), F.col("dtype"), "type_changed")),
        # the partition after the last that has the column, if there is one
        F.when(F.col("next").isNull() | (F.col("next") > nth + 1), entry(nth + 1, F.col("dtype"), none, "removed")),
    ))
    out = seen.select("dataset", "column", F.explode(changes).alias("c")).select("dataset", "column", "c.*")
    return out.join(days, ["dataset", "nth"]).select("dataset", "day", "column", "old", "new", "change")
