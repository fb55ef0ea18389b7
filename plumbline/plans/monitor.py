"""Queries of windows and alerts; their streaming forms are tested against them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType, TimestampType

from ..operators.profile import perf_metrics, r6
from ..operators.tables import last_before
from ..shared import fresh_path, written
from ..streaming import monitor as M
from ..streaming import sketches as SK
from .base import LOG_SQL, events, log, query, retrainings
from .profile import PERF_SQL


def start(seconds):
    return f"strftime(time_bucket(INTERVAL {seconds} SECOND, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start"


@query("st_ingest", "SELECT event_id, user_id, round(value, 6) AS value FROM events")
def st_ingest(spark, sf):
    """Events as JSON files, each twice, read as a stream without repetition."""
    e = events(spark, sf).select("event_id", "ts", "user_id", "value")
    folder, out, mark = (fresh_path(spark, n) for n in ("drop", "ingested", "mark"))
    e.write.json(folder)
    e.write.mode("append").json(folder)
    schema = StructType().add("event_id", LongType()).add("ts", TimestampType()).add("user_id", LongType()).add("value", DoubleType())
    M.replay(M.ingest(spark, folder, schema, "event_id"), out, mark)
    return spark.read.schema(schema).parquet(out).select("event_id", "user_id", r6(F.col("value")).alias("value"))


# Metric, width and number of its buckets.
DISTRIBUTIONS = [("composite", 0.01, 100), ("groundedness", 0.01, 100), ("retrieval", 0.01, 100), ("retrieved", 1.0, 50)]


@query("st_distribution", LOG_SQL + " UNION ALL ".join(
    f"SELECT {start(60)}, '{m}' AS metric, CAST(least(greatest(floor({m} / {w}) + 1, 0), {n + 1}) AS INTEGER) AS bucket, count(*) AS n FROM log WHERE {m} IS NOT NULL GROUP BY ALL" for m, w, n in DISTRIBUTIONS))
def st_distribution(spark, sf):
    """Three scores and the documents retrieved, by minute and bucket; entries without the field aren't counted."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), M.linear_bucket(F.col(m), w, n).alias("bucket")) for m, w, n in DISTRIBUTIONS])
    e = log(spark, sf).select("ts", F.explode(cells).alias("c")).select("ts", "c.*").filter("bucket is not null")
    return M.windowed(e, 60, {"n": F.count("*")}, ["metric", "bucket"])


@query("st_exp_distribution", f"SELECT {start(3600)}, CAST(CASE WHEN value < 1 THEN 0 ELSE least(floor(round(ln(value) / ln(1.1), 9)) + 1, 51) END AS INTEGER) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def st_exp_distribution(spark, sf):
    return M.windowed(events(spark, sf).withColumn("bucket", M.exponential_bucket(F.col("value"), 1.1, 50)), 3600, {"n": F.count("*")}, ["bucket"])


@query("st_counter", LOG_SQL + f"SELECT {start(60)}, count(CASE WHEN composite < 0.25 THEN 1 END) AS low, count(*) AS n, count(retraining) AS retrainings FROM log LEFT JOIN (SELECT retraining FROM retrainings) ON event_id = retraining GROUP BY 1")
def st_counter(spark, sf):
    """Entries with a low composite score, all entries, and retrainings, by minute."""
    e = log(spark, sf).join(F.broadcast(retrainings(spark, sf).select("retraining")), F.col("event_id") == F.col("retraining"), "left")  # a few rows
    return M.windowed(e, 60, {"low": F.count_if(F.col("composite") < 0.25), "n": F.count("*"), "retrainings": F.count("retraining")})


def _firing_sql(src, seconds, hold, by=""):
    """``src`` (start, breach, ...) with firing: breaches in a row that last ``hold`` seconds."""
    key = f"{by}, " if by else ""
    one = f"SELECT *, epoch(start::TIMESTAMP) / {seconds} - row_number() OVER (PARTITION BY {key}breach ORDER BY start) AS i FROM {src}"
    return f"SELECT * EXCLUDE (i), breach AND row_number() OVER (PARTITION BY {key}breach, i ORDER BY start) * {seconds} >= {hold} AS firing FROM ({one})"


_RATE = "avg(CASE WHEN success THEN 0.0 ELSE 1.0 END)"


@query("st_error_rate", LOG_SQL + f", w AS (SELECT {start(60)}, round({_RATE}, 6) AS error_rate, {_RATE} > 0.15 AS breach FROM log GROUP BY 1) " + _firing_sql("w", 60, 300))
def st_error_rate(spark, sf, most=0.15, hold=300):
    w = M.windowed(log(spark, sf), 60, {"rate": F.avg((~F.col("success")).cast("double"))})
    return M.firing(w, F.col("rate") > most, 60, hold, []).select("start", r6(F.col("rate")).alias("error_rate"), "breach", "firing")


@query("st_latency_p95", LOG_SQL + f", w AS (SELECT {start(60)}, round(quantile_cont(latency, 0.95), 6) AS p95, quantile_cont(latency, 0.95) > 10 AS breach FROM log GROUP BY 1) " + _firing_sql("w", 60, 300))
def st_latency_p95(spark, sf, most=10, hold=300):
    w = M.windowed(log(spark, sf), 60, {"p": F.percentile("latency", 0.95)})
    return M.firing(w, F.col("p") > most, 60, hold, []).select("start", r6(F.col("p")).alias("p95"), "breach", "firing")


# Metric, threshold and seconds that its mean must be below it.
SCORE_ALERTS = [("composite", 0.3, 900), ("composite", 0.25, 300), ("groundedness", 0.2, 300), ("retrieval", 0.6, 300)]


@query("st_score_alerts", LOG_SQL + f", m AS (SELECT {start(60)}, avg(composite) AS composite, avg(groundedness) AS groundedness, avg(retrieval) AS retrieval FROM log GROUP BY 1), w AS (" + " UNION ALL ".join(f"SELECT start, '{m}' AS metric, {t}::DOUBLE AS threshold, {h} AS hold, {m} AS v, coalesce({m} < {t}, false) AS breach FROM m" for m, t, h in SCORE_ALERTS)
       + ") SELECT start, metric, threshold, round(v, 6) AS value, firing FROM (" + _firing_sql("w", 60, "hold", "metric, threshold") + ") WHERE breach")
def st_score_alerts(spark, sf):
    """Windows whose mean score is below a rule's threshold; firing once that has lasted the rule's time."""
    w = M.windowed(log(spark, sf), 60, {m: F.avg(m) for m in ("composite", "groundedness", "retrieval")})
    rules = spark.createDataFrame(SCORE_ALERTS, "metric string, threshold double, hold int")  # four rules
    long = w.unpivot("start", ["composite", "groundedness", "retrieval"], "metric", "value").join(F.broadcast(rules), "metric")
    out = M.firing(long, F.col("value") < F.col("threshold"), 60, F.col("hold"), ["metric", "threshold"])
    return out.filter("breach").select("start", "metric", "threshold", r6(F.col("value")).alias("value"), "firing")


def _runs_sql(src, seconds, hold, by=""):
    key = f"{by}, " if by else ""
    return f"SELECT {key}min(start) AS since, max(start) AS until, count(*) AS windows FROM (SELECT *, epoch(start::TIMESTAMP) / {seconds} - row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY start) AS i FROM {src}) GROUP BY {key}i HAVING count(*) * {seconds} >= {hold}"


#: The alert's own rule is 10 low scores a minute for five minutes; the table has two a minute at most, so the query also has one that can fire.
SPIKES = [(10, 60, 300), (1, 3600, 7200)]


@query("st_spike", LOG_SQL + ", " + ", ".join(f"w{s} AS (SELECT {start(s)}, count(CASE WHEN composite < 0.25 THEN 1 END) AS low FROM log GROUP BY 1), b{s} AS (SELECT * FROM w{s} WHERE low > {most})" for most, s, _ in SPIKES)
       + " " + " UNION ALL ".join(f"SELECT {most} AS most, {s} AS seconds, * FROM (" + _runs_sql(f"b{s}", s, hold) + ")" for most, s, hold in SPIKES))
def st_spike(spark, sf):
    """Runs of windows with more than so many low scores, by rule."""
    out = None
    for most, seconds, hold in SPIKES:
        w = M.windowed(log(spark, sf), seconds, {"low": F.count_if(F.col("composite") < 0.25)})
        one = M.sustained(w, F.col("low") > most, seconds, hold, []).select(F.lit(most).alias("most"), F.lit(seconds).alias("seconds"), "since", "until", "windows")
        out = one if out is None else out.union(one)
    return out


@query("st_sustained", f"WITH w AS (SELECT event_type, {start(3600)}, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT * FROM w WHERE v > 40) " + _runs_sql("b", 3600, 10800, "event_type"))
def st_sustained(spark, sf):
    w = M.windowed(events(spark, sf), 3600, {"v": F.avg("value")}, ["event_type"])
    return M.sustained(w, F.col("v") > 40, 3600, 10800, ["event_type"])


@query("st_absence", "WITH s AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 300) AS BIGINT) AS s FROM events), e AS (SELECT min(s) AS a, max(s) AS b FROM s), g AS (SELECT user_id, s, coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY s), a - 1) AS prev FROM s, e UNION ALL SELECT user_id, any_value(b) + 1, max(s) FROM s, e GROUP BY 1) SELECT user_id, strftime(make_timestamp((prev + 1) * 300 * 1000000), '%Y-%m-%d %H:%M:%S') AS since, s - prev - 1 AS windows FROM g WHERE (s - prev - 1) * 300 >= 18000")
def st_absence(spark, sf):
    return M.absence(events(spark, sf), 300, 18000, "user_id")


@query("st_streak", LOG_SQL + f"SELECT {start(60)}, count(*) AS n FROM log WHERE relevance < 0.6 GROUP BY 1 HAVING count(*) > 2")
def st_streak(spark, sf):
    return M.windowed(log(spark, sf).filter("relevance < 0.6"), 60, {"n": F.count("*")}).filter("n > 2")


@query("st_dashboard", LOG_SQL + f"SELECT {start(3600)}, count(*) AS requests, round(avg(CASE WHEN success THEN 0.0 ELSE 1.0 END), 6) AS error_rate, " + ", ".join(f"round(quantile_cont(latency, {p / 100}), 6) AS p{p}" for p in (50, 95, 99)) + ", round(avg(composite), 6) AS mean_composite, round(quantile_cont(composite, 0.5), 6) AS p50_composite, round(quantile_cont(composite, 0.95), 6) AS p95_composite FROM log GROUP BY 1")
def st_dashboard(spark, sf):
    q = lambda c, p: r6(F.percentile(c, p))
    aggs = {"requests": F.count("*"), "error_rate": r6(F.avg((~F.col("success")).cast("double")))} | {f"p{p}": q("latency", p / 100) for p in (50, 95, 99)}
    return M.windowed(log(spark, sf), 3600, aggs | {"mean_composite": r6(F.avg("composite")), "p50_composite": q("composite", 0.5), "p95_composite": q("composite", 0.95)})


_SPANS = [("minute", 60), ("hour", 3600), ("day", 86400)]


@query("st_latency_sketch", LOG_SQL + " UNION ALL ".join(f"SELECT '{name}' AS span, {start(s)}, count(latency) AS n, true AS p50_within, true AS p95_within FROM log WHERE latency IS NOT NULL GROUP BY 2" for name, s in _SPANS))
def st_latency_sketch(spark, sf):
    """Latency sketches by minute, merged to hours and those to days; whether the
    true ranks of their quantiles are within a hundredth of what was asked."""
    e = log(spark, sf).select("ts", "latency")
    kept, out = written(SK.sketches(e, "latency", 60), "minutes"), None
    for name, seconds in _SPANS:
        kept = kept if seconds == 60 else SK.rolled(kept, seconds)
        a, b = (SK.off(kept, e, "latency", seconds, p) for p in (0.5, 0.95))
        one = a.withColumnRenamed("error", "p50").join(b.select("start", F.col("error").alias("p95")), "start")
        one = one.select(F.lit(name).alias("span"), F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", (F.col("p50") <= 0.01).alias("p50_within"), (F.col("p95") <= 0.01).alias("p95_within"))
        out = one if out is None else out.union(one)
    return out


# Metric, threshold and the side that breaches it.
LOOKBACK = [("relevance", 0.7, "below"), ("composite", 0.6, "below"), ("groundedness", 0.1, "below")]


@query("st_lookback", LOG_SQL + ", m AS (SELECT max(ts) AS t FROM log), r AS (SELECT * FROM log, m WHERE ts > t - INTERVAL 24 HOUR) " + " UNION ALL ".join(f"SELECT '{c}' AS metric, {t}::DOUBLE AS threshold, count({c}) AS points, coalesce(bool_or({c} {'<' if s == 'below' else '>'} {t}), false) AS breached FROM r" for c, t, s in LOOKBACK))
def st_lookback(spark, sf, hours=24):
    e = log(spark, sf)
    until = e.agg(F.max("ts").alias("until"))  # one row
    r = e.join(F.broadcast(until)).filter(F.col("ts") > F.col("until") - F.expr(f"interval {hours} hours"))
    long = r.select(*[c for c, _, _ in LOOKBACK]).unpivot([], [c for c, _, _ in LOOKBACK], "metric", "value")
    rules = spark.createDataFrame(LOOKBACK, "metric string, threshold double, side string")  # three rules
    hit = F.when(F.col("side") == "below", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return long.join(F.broadcast(rules), "metric").groupBy("metric", "threshold").agg(F.count("value").alias("points"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("breached"))


_DAY = LOG_SQL + f""", d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, max(ts) AS run, {PERF_SQL}, avg(value) AS mv FROM (SELECT *, latency AS value FROM log) GROUP BY 1),
    f AS (SELECT d.*, abs(mv - (SELECT avg(latency) FROM log)) > 3 AS has_drift, retrained_at AS last FROM d ASOF LEFT JOIN retrainings ON d.run >= retrainings.ts)"""
_REASONS = "concat_ws(',', CASE WHEN has_drift THEN 'drift' END, CASE WHEN avg_composite < 0.3 THEN 'composite' END, CASE WHEN min_composite < 0.25 THEN 'min_composite' END, CASE WHEN avg_groundedness < 0.2 THEN 'groundedness' END, CASE WHEN coverage < 1 THEN 'coverage' END, CASE WHEN error_rate > 0.15 THEN 'error_rate' END, CASE WHEN p95_latency > 10 THEN 'latency' END, CASE WHEN avg_relevance < 0.6 THEN 'relevance' END)"


# days are worked through in their order, since a decision blocks those after it
_COOLED = f"""
    w AS (SELECT *, CASE WHEN has_drift THEN 'full' WHEN reasons <> '' THEN 'model_only' ELSE 'none' END AS wanted, row_number() OVER (ORDER BY day) AS i FROM r),
    c(i, own, last, since, blocked) AS (
        SELECT 0::BIGINT, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::BIGINT, false
        UNION ALL
        SELECT i, CASE WHEN wanted <> 'none' AND NOT blocked THEN run ELSE own END, last, since, blocked FROM (
            SELECT *, wanted <> 'none' AND coalesce(since < {M.COOL_DOWN}, false) AS blocked FROM (
                SELECT w.i, run, wanted, own, w.last, CAST(floor(epoch(run - greatest(own, w.last)) / 86400) AS BIGINT) AS since FROM c JOIN w ON w.i = c.i + 1)))
"""


@query("st_decision", "WITH RECURSIVE" + _DAY.lstrip()[4:] + f", r AS (SELECT *, {_REASONS} AS reasons FROM f), " + _COOLED + """
    SELECT day, CASE WHEN c.blocked THEN 'none' ELSE wanted END AS strategy, c.blocked AS blocked, NOT c.blocked AND wanted <> 'none' AS needs_retraining, reasons, since AS days_since FROM w JOIN c USING (i)""")
def st_decision(spark, sf):
    """Each day's decision; the last retraining is that of the history before the
    day's last entry, or of a decision before it."""
    e = log(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    mean = e.agg(F.avg("latency").alias("all"))  # one row
    days = e.groupBy("day").agg(F.avg("latency").alias("mv"), F.max("ts").alias("ts")).join(F.broadcast(mean))
    days = days.select("day", "ts", (F.abs(F.col("mv") - F.col("all")) > 3).alias("has_drift"))
    days = last_before(days, retrainings(spark, sf), "ts", [], ["retrained_at"])
    m = M.decision(perf_metrics(e, ["day"]).join(days, "day"))
    return M.cool_down(m, "ts", "retrained_at", []).select("day", "strategy", "blocked", "needs_retraining", "reasons", "days_since")
