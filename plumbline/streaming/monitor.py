"""Aligned windows over a log: the same functions for a batch and for a stream.

A streaming frame gets its watermark by ``late``.  Sustained breaches and
absences need the order of windows: those here are of a batch; ``stateful``
has them of a stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructType


def late(log: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Rows later than ``delay`` are dropped, if the frame is a stream."""
    return log.withWatermark(ts, delay) if log.isStreaming else log


def windowed(log: DataFrame, seconds: int, aggs: dict[str, Column], by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """One row per tumbling window (and ``by``): start and the aggregates."""
    g = late(log, ts).groupBy(F.window(ts, f"{seconds} seconds"), *(by or []))
    return g.agg(*[c.alias(n) for n, c in aggs.items()]).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *(by or []), *aggs)


def linear_bucket(x: Column, width: float, n: int) -> Column:
    """0 below the first bucket, 1..n, n + 1 above the last; null of null."""
    return F.when(x.isNotNull(), F.least(F.greatest(F.floor(x / width) + 1, F.lit(0)), F.lit(n + 1))).cast("int")


def exponential_bucket(x: Column, growth: float, n: int, scale: float = 1.0) -> Column:
    return F.when(x < scale, 0).otherwise(F.least(F.floor(F.round(F.log(x / scale) / F.log(F.lit(growth)), 9)) + 1, F.lit(n + 1))).cast("int")


def sustained(windows: DataFrame, breach: Column, seconds: int, hold: int, by: list[str]) -> DataFrame:
    """Runs of consecutive breaching windows that last ``hold`` seconds or more."""
    w = windows.withColumn("_t", F.unix_timestamp("start", "yyyy-MM-dd HH:mm:ss")).filter(breach)
    order = Window.partitionBy(*by).orderBy("_t") if by else Window.partitionBy(F.lit(0)).orderBy("_t")
    w = w.withColumn("_i", F.col("_t") / seconds - F.row_number().over(order))
    runs = w.groupBy(*by, "_i").agg(F.min("start").alias("since"), F.max("start").alias("until"), F.count("*").alias("windows"))
    return runs.filter(F.col("windows") * seconds >= hold).drop("_i")


def firing(windows: DataFrame, breach: Column, seconds: int, hold: Column | int, by: list[str]) -> DataFrame:
    """``windows`` with breach and firing: a window fires when it and the
    breaching windows that come right before it last ``hold`` seconds."""
    w = windows.withColumn("breach", F.coalesce(breach, F.lit(False))).withColumn("_hold", hold if isinstance(hold, Column) else F.lit(hold))
    w = w.withColumn("_t", F.unix_timestamp("start", "yyyy-MM-dd HH:mm:ss"))
    keys = [F.col(c) for c in by] or [F.lit(0)]
    w = w.withColumn("_i", F.col("_t") / seconds - F.row_number().over(Window.partitionBy(*keys, "breach").orderBy("_t")))
    place = F.row_number().over(Window.partitionBy(*keys, "breach", "_i").orderBy("_t"))
    return w.withColumn("firing", F.col("breach") & (place * seconds >= F.col("_hold"))).drop("_t", "_i", "_hold")


def absence(log: DataFrame, seconds: int, hold: int, by: str, ts: str = "ts") -> DataFrame:
    """Gaps without any whole window's request for ``hold`` seconds or more,
    between the first and the last window of the log, for each ``by``."""
    slot = F.floor(F.unix_timestamp(ts) / seconds)
    seen = log.groupBy(by, slot.alias("s")).agg(F.count("*").alias("n"))
    ends = seen.agg(F.min("s").alias("a"), F.max("s").alias("b"))  # one row
    w = Window.partitionBy(by).orderBy("s")
    inner = seen.select(by, F.col("s"), F.lag("s").over(w).alias("prev"))
    last = seen.groupBy(by).agg(F.max("s").alias("prev")).join(F.broadcast(ends)).select(by, (F.col("b") + 1).alias("s"), "prev")
    gaps = inner.join(F.broadcast(ends)).select(by, "s", F.coalesce("prev", F.col("a") - 1).alias("prev")).union(last)
    return gaps.withColumn("missing", F.col("s") - F.col("prev") - 1).filter(F.col("missing") * seconds >= hold).select(by, F.date_format(F.timestamp_seconds((F.col("prev") + 1) * seconds), "yyyy-MM-dd HH:mm:ss").alias("since"), F.col("missing").cast("long").alias("windows"))


def ingest(spark: SparkSession, folder: str, schema: StructType, key: str, ts: str = "ts") -> DataFrame:
    """A stream of new JSON files in ``folder``; a key is taken once within the watermark."""
    s = spark.readStream.schema(schema).json(folder)
    return s.withWatermark(ts, "10 minutes").dropDuplicatesWithinWatermark([key])


def replay(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", listener=None) -> None:
    """Run a stream over what there is and write it as Parquet.  A ``listener``
    with ``add`` has heard of all batches when this returns."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    for progress in q.recentProgress if listener is not None else ():
        listener.add(progress)


def decision(metrics: DataFrame) -> DataFrame:
    """wanted and reasons of each row of monitoring metrics.

    Drift asks for "full", any breached threshold for "model_only".  The
    reference's test of groundedness is a minimum although its name says maximum.
    """
    rules = [
        ("composite", F.col("avg_composite") < 0.3), ("min_composite", F.col("min_composite") < 0.25), ("groundedness", F.col("avg_groundedness") < 0.2), ("coverage", F.col("coverage") < 1.0),
        ("error_rate", F.col("error_rate") > 0.15), ("latency", F.col("p95_latency") > 10.0), ("relevance", F.col("avg_relevance") < 0.6),
    ]
    d = metrics.withColumn("_r", F.array_compact(F.array(F.when(F.col("has_drift"), "drift"), *[F.when(c, n) for n, c in rules])))
    wanted = F.when(F.col("has_drift"), "full").when(F.size("_r") > 0, "model_only").otherwise("none")
    return d.withColumn("wanted", wanted).withColumn("reasons", F.array_join("_r", ",")).drop("_r")


#: Days after a retraining in which there is no other.
COOL_DOWN = 7


def cool_down(wanted: DataFrame, run: str, last: str, by: list[str], days: int = COOL_DOWN) -> DataFrame:
    """``wanted`` with strategy, blocked, needs_retraining and days_since.

    A run is blocked if fewer than ``days`` whole days have passed since the
    last retraining: that of the history (``last``, null if none), or one that
    an earlier run of the same ``by`` has asked for, whichever is later.  Runs
    of one ``by`` are worked through in one task, in their order; they are
    reports (some a day), not rows of data.
    """
    schema = StructType([*wanted.schema]).add("strategy", StringType()).add("blocked", BooleanType()).add("needs_retraining", BooleanType()).add("days_since", LongType())

    def work(runs: pd.DataFrame) -> pd.DataFrame:
        runs, own, out = runs.sort_values(run, kind="stable"), None, []
        for now, before, want in zip(runs[run], runs[last], runs["wanted"]):
            known = [t for t in (own, before) if t is not None and not pd.isna(t)]
            since = (now - max(known)).days if known else None
            blocked = want != "none" and since is not None and since < days
            if want != "none" and not blocked:
                own = now
            out.append(("none" if blocked else want, blocked, want != "none" and not blocked, since))
        more = pd.DataFrame(out, columns=["strategy", "blocked", "needs_retraining", "days_since"], index=runs.index)
        return pd.concat([runs, more.astype({"days_since": "Int64"})], axis=1)

    if not by:
        one = wanted.withColumn("_one", F.lit(0))
        return cool_down(one, run, last, ["_one"], days).drop("_one")
    return wanted.groupBy(*by).applyInPandas(work, schema)
