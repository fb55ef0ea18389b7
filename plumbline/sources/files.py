"""Scans and sinks over files, lists and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..operators.tables import PARTITION
from ..shared import written


#: Rows of a partition that one task writes.
FILE_ROWS = 2_000_000


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines that parse and have no error; text columns of which more than
    half of the rows parse as a date become timestamps."""
    raw = spark.read.text(path)
    # a line is parsed once; what doesn't parse has a corrupt record
    wide = StructType([*schema.fields]).add("error", StringType()).add("_bad", StringType())
    rows = raw.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    good = rows.filter(F.col("_bad").isNull() & F.col("error").isNull()).drop("_bad", "error")
    text = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
    if not text:
        return good
    share = good.agg(*[(F.count(F.try_to_timestamp(F.col(c))) * 2 > F.count("*")).alias(c) for c in text]).first()
    return good.withColumns({c: F.try_to_timestamp(F.col(c)) for c in text if share[c]})


def list_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Paths of the files under ``path``, whatever its depth; none is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


def read_partitions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All CSV files of the partitions base/YYYY/MM/DD under ``path``, with
    ``_partition_path`` and ``_partition_timestamp`` of each row.

    Files elsewhere are left out, files that can't be read and rows that don't
    parse are skipped.
    """
    read = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True)
    df = read.schema(schema).csv(path)
    file = F.col("_metadata.file_path")
    day = F.concat_ws("/", *[F.regexp_extract(file, PARTITION, i) for i in (1, 2, 3)])
    out = df.select("*", day.alias("_partition_path"), F.try_to_timestamp(day, F.lit("yyyy/MM/dd")).alias("_partition_timestamp"))
    return out.filter("_partition_timestamp is not null")


#: The catalogue beside the partitions; a name that readers of the data skip.
CATALOGUE = "_catalogue"


def write_partitions(df: DataFrame, path: str, day: str, dataset: str) -> DataFrame:
    """Write under dataset/y/m and return the catalogue: rows and columns of
    each partition.

    Partitions that ``df`` has rows of are replaced, the others stay, and so
    do their entries in the catalogue.  Rows of a partition are dealt over
    tasks of about ``FILE_ROWS`` rows by a hash, so that none, however large,
    is one task.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if not c.startswith("_partition")]
    out = df.select(*own, F.lit(dataset).alias("dataset"), F.year(day).alias("y"), F.month(day).alias("m"))
    sizes = written(out.groupBy("dataset", "y", "m").agg(F.count("*").alias("rows")), "sizes")  # a row a partition
    files = sizes.select("dataset", "y", "m", F.ceil(F.col("rows") / FILE_ROWS).alias("_files"))
    same = [out[c].eqNullSafe(files[c]) for c in ("dataset", "y", "m")]
    dealt = out.join(F.broadcast(files), same).select(*[out[c] for c in out.columns], "_files").withColumn("_salt", F.pmod(F.xxhash64(*own), F.col("_files")))
    writer = dealt.repartition("y", "m", "_salt").select(out.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dataset", "y", "m").parquet(path)
    entries = sizes.select("dataset", "y", "m", "rows", F.lit(len(own)).cast("long").alias("columns"), F.unix_micros(F.current_timestamp()).alias("written"))
    entries.write.mode("append").parquet(f"{path}/{CATALOGUE}")
    return partition_catalogue(spark, path)


def partition_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, y, m, rows, columns) of each partition under ``path``, as it was written last."""
    kept = spark.read.parquet(f"{path}/{CATALOGUE}")
    last = kept.groupBy("dataset", "y", "m").agg(F.max_by(F.struct("rows", "columns"), "written").alias("e"))
    return last.select("dataset", "y", "m", "e.*")


def url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed lines that aren't empty or comments and start with http."""
    t = F.trim(column)
    return lines.select(t.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#") & F.col("url").startswith("http"))


def next_version(names: DataFrame, name: str, prefix: Column) -> DataFrame:
    """Next number after the last "v" of the names under each prefix."""
    v = F.regexp_extract(name, r"v(\d+)$", 1).try_cast("long")
    return names.groupBy(prefix.alias("prefix")).agg((F.coalesce(F.max(v), F.lit(-1)) + 1).alias("next_version"))


# Spellings of the keys of a question and of an answer.
QUESTION_KEYS, ANSWER_KEYS = ["Q", "question", "query", "prompt"], ["A", "answer", "response", "completion"]


def qa_pairs(records: DataFrame, column: str = "value") -> DataFrame:
    """question and answer of JSON records; pairs that miss either are skipped."""
    get = lambda keys: F.coalesce(*[F.nullif(F.trim(F.get_json_object(column, f"$.{k}")), F.lit("")) for k in keys])
    out = records.withColumn("question", get(QUESTION_KEYS)).withColumn("answer", get(ANSWER_KEYS))
    return out.filter("question is not null and answer is not null")


PREDICTION = "success boolean, latency double, query string, composite_score double, retrieved array<struct<doc_id:long,score:double>>, index_size long"


def prediction_log(log: DataFrame, payload: str, ts: str, until: Column, hours: int = 24, most: int | None = 10_000) -> DataFrame:
    """Entries of the last hours with a payload, flat, defaults filled; the
    newest ``most`` of them (the report's limit), or all if that is None."""
    rows = log.withColumn("p", F.from_json(F.get_json_object(payload, "$.prediction_result"), PREDICTION)).filter("p is not null")
    rows = rows.filter((F.col(ts) <= until) & (F.col(ts) > until - F.expr(f"interval {hours} hours")))
    flat = rows.select(
        "event_id", ts, F.coalesce("p.success", F.lit(True)).alias("success"), F.coalesce("p.latency", F.lit(0.0)).alias("latency"), F.coalesce("p.latency", F.lit(0.0)).alias("response_time"),
        F.col("p.composite_score").alias("composite_score"), F.coalesce(F.size("p.retrieved"), F.lit(0)).alias("num_docs"), F.coalesce("p.index_size", F.lit(0)).cast("long").alias("index_size"),
    )
    return flat if most is None else flat.orderBy(F.desc(ts), F.desc("event_id")).limit(most)
