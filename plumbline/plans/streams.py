"""Alerts on a live stream: ``events`` replayed as files that arrive one after the other.

A stream closes a window when rows well past its end have come, so each replay
ends with a row of no key that is far later than the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import oracle_of
from ..shared import fresh_path
from ..streaming import monitor as M
from ..streaming import stateful as S
from . import monitor  # noqa: F401  (its SQL is that of the streams)
from .base import LOG_SQL, events, log, query

#: Files that a replay arrives in.
ARRIVALS = 3
COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


def arrivals(df: DataFrame, folder: str, parts: int = ARRIVALS, ts: str = "ts") -> None:
    """Write a table's rows to ``folder``, one span of time after the other, and the closing row."""
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()  # one row
    if ends["a"] is not None:
        step = (ends["b"] - ends["a"]) / parts
        for k in range(parts):
            span = F.col(ts) >= F.lit(ends["a"] + k * step)
            if k + 1 < parts:
                span = span & (F.col(ts) < F.lit(ends["a"] + (k + 1) * step))
            df.filter(span).write.mode("append").parquet(folder)
    close(df, folder, ts)


def close(df: DataFrame, folder: str, ts: str = "ts") -> None:
    """The closing row: null but for a time that is later than any row's."""
    one = df.sparkSession.range(1).select(*[(F.lit("9000-01-01").cast("timestamp") if c == ts else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    one.write.mode("append").parquet(folder)


def live(df: DataFrame, folder: str) -> DataFrame:
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 64).parquet(folder)


def replayed(df: DataFrame, alerts, schema: str) -> DataFrame:
    """What ``alerts``, a function of a stream, tells of a table's rows as they arrive."""
    spark = df.sparkSession
    folder, out, mark = (fresh_path(spark, n) for n in ("arriving", "alerts", "mark"))
    arrivals(df, folder)
    with S.state_store(spark):
        M.replay(alerts(live(df, folder)), out, mark)
    return spark.read.schema(schema).parquet(out)


def at(seconds: str) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


@query("st_sustained_stream", oracle_of("st_sustained"))
def st_sustained_stream(spark, sf):
    """Runs of hours with a mean value over 40, three at least, as a stream tells them when they end."""
    told = lambda s: S.sustained_stream(s, {"v": F.avg("value")}, F.col("v") > 40, 3600, 10800, ["event_type"])
    runs = replayed(events(spark, sf).select(*COLUMNS), told, "event_type string, state string, since long, until long, windows long")
    return runs.filter("state = 'ended' and event_type is not null").select("event_type", at("since").alias("since"), at("until").alias("until"), "windows")


@query("st_absence_stream", oracle_of("st_absence"))
def st_absence_stream(spark, sf, seconds=300, hold=18000):
    """Users without a request for five hours: gaps that ended, and those still open at the end of the log."""
    e = events(spark, sf).select(*COLUMNS)
    slot = F.floor(F.unix_timestamp("ts") / seconds) * seconds
    ends = e.agg(F.min(slot).alias("a"), F.max(slot).alias("b")).first()  # one row
    told = replayed(e, lambda s: S.absence_stream(s, seconds, hold, ["user_id"], ends["a"]), "user_id long, state string, since long, windows long")
    told = told.filter("user_id is not null")
    # an absent key that came back has told the whole gap
    gaps = told.groupBy("user_id", "since").agg(F.max(F.when(F.col("state") == "returned", F.col("windows"))).alias("windows"))
    windows = F.coalesce("windows", F.floor((F.lit(ends["b"]) - F.col("since")) / seconds) + 1)
    return gaps.select("user_id", at("since").alias("since"), windows.cast("long").alias("windows")).filter(F.col("windows") * seconds >= hold)


_SESSIONS = LOG_SQL + """
    , low AS (SELECT event_type, ts FROM log JOIN events USING (event_id, ts) WHERE relevance < 0.6),
    marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM low WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    islands AS (SELECT *, sum(begins) OVER (PARTITION BY event_type ORDER BY ts) AS island FROM marked)
    SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS until, count(*) AS n
    FROM islands GROUP BY event_type, island HAVING count(*) > 2
"""


def _low(spark, sf):
    e = log(spark, sf).select("event_id", "ts", "relevance").filter("relevance < 0.6")
    return e.join(events(spark, sf).select("event_id", "event_type"), "event_id")


def _shown(found: DataFrame) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("event_type", text("since"), text("until"), F.col("n").cast("long").alias("n"))


@query("st_streak_sessions", _SESSIONS)
def st_streak_sessions(spark, sf):
    """Streaks of more than two events of low confidence, each within half an hour of the one before."""
    return _shown(S.sessions(_low(spark, sf), "30 minutes", 3, ["event_type"]))


@query("st_streak_sessions_stream", _SESSIONS)
def st_streak_sessions_stream(spark, sf):
    """The same of a stream; a session that spans two arrivals merges in the state store."""
    told = replayed(_low(spark, sf), lambda s: S.sessions(s, "30 minutes", 3, ["event_type"]), "event_type string, since timestamp, until timestamp, n long")
    return _shown(told.filter("event_type is not null"))


_LATE = f"""
    WITH spans AS (SELECT *, least(2, (extract(day FROM ts) - 1) // 10) AS batch FROM events),
    sent AS (SELECT ts, batch FROM spans UNION ALL SELECT ts, 2 FROM spans WHERE batch = 0 AND event_id % 7 = 0),
    marks AS (SELECT b.batch, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM sent WHERE sent.batch < b.batch) AS mark FROM (SELECT DISTINCT batch FROM sent) b)
    SELECT batch::BIGINT AS batch, count(*) AS input_rows, count(CASE WHEN ts <= mark THEN 1 END) AS dropped FROM sent JOIN marks USING (batch) GROUP BY batch
"""


@query("st_late_rows", _LATE)
def st_late_rows(spark, sf):
    """Rows that each batch read and that came too late for the watermark.

    Ten days arrive at a time; a seventh of the first ten days' events comes
    once more, under new ids, with the last.
    """
    e = events(spark, sf).select(*COLUMNS).withColumn("span", F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10)).cast("int"))
    again = e.filter("span = 0 and event_id % 7 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000).withColumn("span", F.lit(2))
    sent, told = e.union(again), S.LateRows()
    folder, out, mark = (fresh_path(spark, n) for n in ("late", "kept", "mark"))
    spark.streams.addListener(told)
    try:
        # each span is sent and read before the next one comes
        for k in range(3):
            sent.filter(F.col("span") == k).drop("span").write.mode("append").parquet(folder)
            stream = S.once(live(e.drop("span"), folder), "event_id")
            M.replay(stream, out, mark, listener=told)
    finally:
        spark.streams.removeListener(told)
    # batches that only close windows read nothing
    nth = F.row_number().over(Window.orderBy("batch")) - 1
    return told.table(spark).filter("input_rows > 0").select(nth.cast("long").alias("batch"), "input_rows", "dropped")
