"""What the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as a prediction log: errors are failures, value is latency."""
    e = events(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("double")
    score = lambda c: F.when(F.col("event_type") != "error", c)
    return e.select(
        "event_id", "ts", "user_id", (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency"), score(k / 100).alias("relevance"), score(F.col("value") % 1).alias("composite"),
        score(k / 200).alias("groundedness"), score(F.lit(1.0) / (1 + k / 100)).alias("retrieval"), F.when(F.col("event_type") != "error", F.col("user_id")).alias("doc_id"), F.lit(1000).cast("double").alias("index_size"),
        score(k % 60).alias("retrieved"),
    )


def retrainings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few ``events`` that stand in for a model's retrainings: retrained_at, retraining."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = events(spark, sf_dir).filter((F.col("event_type") == "signup") & (k == 77) & (F.col("user_id") < 15))
    return e.select("ts", F.col("ts").alias("retrained_at"), F.col("event_id").alias("retraining"))


#: The same log for DuckDB.
LOG_SQL = """
    WITH raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
    log AS (SELECT event_id, ts, user_id, event_type <> 'error' AS success, value AS latency,
        CASE WHEN event_type <> 'error' THEN k / 100 END AS relevance, CASE WHEN event_type <> 'error' THEN value % 1 END AS composite,
        CASE WHEN event_type <> 'error' THEN k / 200 END AS groundedness, CASE WHEN event_type <> 'error' THEN 1 / (1 + k / 100) END AS retrieval,
        CASE WHEN event_type <> 'error' THEN user_id END AS doc_id, 1000.0::DOUBLE AS index_size,
        CASE WHEN event_type <> 'error' THEN k % 60 END AS retrieved FROM raw),
    retrainings AS (SELECT ts, ts AS retrained_at, event_id AS retraining FROM raw WHERE event_type = 'signup' AND k = 77 AND user_id < 15)
"""


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def q(s: str) -> str:
    """A string literal of DuckDB."""
    return "'" + s.replace("'", "''") + "'"
