"""Queries of the data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import AFTER, BEFORE
from ..operators import quality as Q
from ..operators.profile import r6, stacked
from ..operators.tables import schema_diff
from ..shared import fresh_path, written
from ..sources import schemas as C
from ..registry import oracle_of
from . import profile, stats  # their SQL is part of a run's
from .base import events, query, table

RULES = [
    ("between", "o_totalprice", (1000.0, 400000.0)), ("in_set", "o_orderstatus", ["O", "F"]), ("not_null", "o_orderdate", None), ("unique", "o_orderkey", None), ("unique", "o_custkey", None), ("between", "absent", (0, 1)),
]


@query("dq_validate", """SELECT *, violations = 0 AS passed FROM (SELECT 'between' AS rule, 'o_totalprice' AS "column", count(CASE WHEN NOT o_totalprice BETWEEN 1000 AND 400000 THEN 1 END) AS violations FROM orders UNION ALL SELECT 'in_set', 'o_orderstatus', count(CASE WHEN o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F') THEN 1 END) FROM orders
    UNION ALL SELECT 'not_null', 'o_orderdate', count(*) - count(o_orderdate) FROM orders UNION ALL SELECT 'unique', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'unique', 'o_custkey', count(*) - count(DISTINCT o_custkey) FROM orders)""")
def dq_validate(spark, sf):
    return Q.expectations(table(spark, sf, "orders"), RULES)


@query("dq_image_meta", "SELECT count(DISTINCT split_part(url, ':', 1)) > 1 AS many_formats, count(DISTINCT n) > 1 AS many_sizes, count(CASE WHEN n < 1000 THEN 1 END) AS small_files, stddev_samp(n) / avg(n) > 0.5 AS size_varies, count(CASE WHEN b < 10 THEN 1 END) AS dark, count(CASE WHEN b > 245 THEN 1 END) AS bright, count(*) - count(html) AS nulls FROM (SELECT *, length(html) AS n, floor(255.0 * (length(html) - length(replace(html, ' ', ''))) / length(html)) AS b FROM pages)")
def dq_image_meta(spark, sf):
    """A page stands in for an image: its length for the size, the share of blanks, of 255, for the brightness."""
    blanks = F.char_length("html") - F.char_length(F.replace("html", F.lit(" "), F.lit("")))
    p = table(spark, sf, "pages").select(F.split("url", ":")[0].alias("fmt"), F.char_length("html").alias("n"), F.floor(F.try_divide(255 * blanks, F.char_length("html"))).alias("b"))
    return p.agg((F.count_distinct("fmt") > 1).alias("many_formats"), (F.count_distinct("n") > 1).alias("many_sizes"), F.count_if(F.col("n") < 1000).alias("small_files"), (F.stddev_samp("n") / F.avg("n") > 0.5).alias("size_varies"), F.count_if(F.col("b") < 10).alias("dark"), F.count_if(F.col("b") > 245).alias("bright"), F.count_if(F.col("n").isNull()).alias("nulls"))


_RAW = "(SELECT CASE WHEN doc_id % 9 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS id, lang, n_chars::VARCHAR AS n, CASE WHEN doc_id % 7 = 0 THEN 'soon' ELSE '2024-01-02' END AS d FROM documents)"


@query("dq_types", f"SELECT 'id' AS \"column\", 'int' AS kind, count(CASE WHEN NOT regexp_full_match(id, '[+-]?[0-9]+') THEN 1 END) AS offenders FROM {_RAW} UNION ALL SELECT 'lang', 'allowed', count(CASE WHEN lang NOT IN ('en', 'de') THEN 1 END) FROM {_RAW} UNION ALL SELECT 'n', 'range', count(CASE WHEN n::BIGINT NOT BETWEEN 10 AND 5000 THEN 1 END) FROM {_RAW} UNION ALL SELECT 'd', 'datetime', count(CASE WHEN try_cast(d AS DATE) IS NULL THEN 1 END) FROM {_RAW}")
def dq_types(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select(F.when(k % 9 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("id"), "lang", F.col("n_chars").cast("string").alias("n"), F.when(k % 7 == 0, "soon").otherwise("2024-01-02").alias("d"))
    one = d.agg(F.count_if(F.col("id").isNotNull() & F.expr("try_cast(id as bigint)").isNull()).alias("a"), F.count_if(~F.col("lang").isin("en", "de")).alias("b"), F.count_if(~F.expr("try_cast(n as bigint)").between(10, 5000)).alias("c"), F.count_if(F.expr("try_cast(d as date)").isNull() & F.col("d").isNotNull()).alias("e"))
    return stacked(one, [("id", [F.lit("int"), F.col("a")]), ("lang", [F.lit("allowed"), F.col("b")]), ("n", [F.lit("range"), F.col("c")]), ("d", [F.lit("datetime"), F.col("e")])], ["kind", "offenders"])


@query("dq_schema", "SELECT * FROM (VALUES ('o_totalprice', 'missing'), ('o_orderkey', 'compatible'), ('o_orderstatus', 'mismatch'), ('extra', 'extra')) t(\"column\", status), (SELECT count(*) AS rows FROM orders)")
def dq_schema(spark, sf):
    """A written table's columns against those of its baseline, both from the footers of their files."""
    o = table(spark, sf, "orders")
    base, new = o.select("o_orderkey", "o_orderstatus", "o_totalprice"), o.select(F.col("o_orderkey").cast("int").alias("o_orderkey"), F.ascii("o_orderstatus").alias("o_orderstatus"), F.lit(1).alias("extra"))
    path = fresh_path(spark, "schemas")
    for name, df in (("base", base), ("new", new)):
        df.write.parquet(f"{path}/day={name}")
    found = written(C.catalogue(C.footers(spark, path), "orders"), "catalogue")
    numbers = ["int", "bigint", "double", "float"]
    s = schema_diff(*(found.filter(F.col("day") == day).select("column", "dtype") for day in ("base", "new")))
    status = F.when(F.col("change") == "removed", "missing").when(F.col("change") == "added", "extra").when(F.col("old").isin(numbers) == F.col("new").isin(numbers), "compatible").otherwise("mismatch")
    rows = found.filter("day = 'new'").agg(F.max("rows").alias("rows"))  # one row
    return s.select("column", status.alias("status")).join(F.broadcast(rows))


@query("dq_checks", "SELECT 'text' AS \"column\", count(text) > 0 AS passed FROM documents UNION ALL SELECT 'source', count(source) > 0 FROM documents UNION ALL SELECT 'n_chars', count(CASE WHEN n_chars > 0 THEN 1 END) * 2 > count(*) FROM documents")
def dq_checks(spark, sf):
    one = table(spark, sf, "documents").agg(F.count("text").alias("t"), F.count("source").alias("s"), F.count_if(F.col("n_chars") > 0).alias("p"), F.count("*").alias("n"))
    return stacked(one, [("text", [F.col("t") > 0]), ("source", [F.col("s") > 0]), ("n_chars", [F.col("p") * 2 > F.col("n")])], ["passed"])


def _measured(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", "text", F.regexp_count("text", F.lit(r"\S+")).alias("word_count"), F.split("text", "\n", -1).alias("lines"))


def _base(d):
    """Baseline statistics of every second document of a usual size."""
    b = d.filter("doc_id % 2 = 0 and n_chars between 200 and 5000")
    kinds = (("n_chars", F.col("n_chars")), ("text", F.char_length("text")), ("lines", F.size("lines")))
    return b.agg(*[x for c, m in kinds for x in (F.min(m).alias(f"lo_{c}"), F.max(m).alias(f"hi_{c}"), (100 * F.count_if(m.isNull()) / F.count("*")).alias(f"nulls_{c}"))])


_VIOLATIONS = "CASE WHEN n_chars < lo THEN 'n_chars below min' END, CASE WHEN n_chars > hi THEN 'n_chars above max' END, CASE WHEN length(text) < 0.5 * tl THEN 'text too short' END, CASE WHEN length(text) > 2 * th THEN 'text too long' END, CASE WHEN len(lines) > 2 * lh THEN 'lines too many' END, CASE WHEN words < 100 THEN 'word_count below 100' END, CASE WHEN words > 10000 THEN 'word_count above 10000' END"


@query("dq_anomalies", f"""WITH d AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS words, string_split(text, chr(10)) AS lines FROM documents), b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi, min(length(text)) AS tl, max(length(text)) AS th, max(len(lines)) AS lh FROM d WHERE doc_id % 2 = 0 AND n_chars BETWEEN 200 AND 5000) SELECT * FROM (SELECT doc_id, concat_ws('; ', {_VIOLATIONS}) AS violations FROM d, b) WHERE violations <> ''""")
def dq_anomalies(spark, sf):
    d = _measured(spark, sf)
    return Q.anomalies(d, _base(d), "doc_id", ["n_chars"], ["text"], ["lines"], "word_count")


@query("dq_completeness", "SELECT issue, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, 'no topics' AS issue FROM documents WHERE NOT regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(the|der|les)([^\\p{L}\\p{N}_]|$)') UNION ALL SELECT doc_id, 'blank text' FROM documents WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT doc_id, 'short source' FROM documents WHERE length(source) < 5) GROUP BY 1")
def dq_completeness(spark, sf):
    d = table(spark, sf, "documents")
    issues = F.array_compact(F.array(F.when(~F.col("text").rlike(f"{BEFORE}(the|der|les){AFTER}"), "no topics"), F.when(F.col("text").isNull() | (F.trim("text") == ""), "blank text"), F.when(F.char_length("source") < 5, "short source")))
    return d.select("doc_id", F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def _run_sql() -> str:
    """The run from the SQL of its parts."""
    part = lambda check, item, value, name: f"SELECT '{check}' AS \"check\", {item} AS item, CAST({value} AS DOUBLE) AS value FROM ({oracle_of(name)})"
    parts = [
        ("schema", '"column"', "CASE WHEN status = 'compatible' THEN 0 ELSE 1 END", "dq_schema"), ("types", '"column"', "offenders", "dq_types"), ("anomalies", "''", "count(*)", "dq_anomalies"),
        ("anomaly_pct", "''", "round(100 * count(*) / (SELECT count(*) FROM documents), 6)", "dq_anomalies"), ("completeness", "issue", "n", "dq_completeness"), ("dominance", '"column"', "percent", "agg_dominance"), ("drift", "feature", "statistic", "stat_detect_all"),
    ]
    return " UNION ALL ".join(["SELECT 'rows' AS \"check\", '' AS item, CAST(count(*) AS DOUBLE) AS value FROM documents", *[part(*p) for p in parts]])


@query("dq_validate_run", _run_sql())
def dq_validate_run(spark, sf):
    """Schema, types, anomalies, completeness, dominance and drift, as one long table."""
    d = table(spark, sf, "documents")
    n = d.agg(F.count("*").cast("double").alias("value")).select(F.lit("rows").alias("check"), F.lit("").alias("item"), "value")
    out = n.union(dq_schema(spark, sf).select(F.lit("schema"), "column", F.when(F.col("status") == "compatible", 0.0).otherwise(1.0)))
    out = out.union(dq_types(spark, sf).select(F.lit("types"), "column", F.col("offenders").cast("double")))
    found = dq_anomalies(spark, sf).agg(F.count("*").cast("double").alias("v"))  # one row
    out = out.union(found.select(F.lit("anomalies"), F.lit(""), "v"))
    share = found.join(F.broadcast(n)).select(F.lit("anomaly_pct"), F.lit(""), r6(F.try_divide(100 * F.col("v"), "value")))
    out = out.union(share)
    out = out.union(dq_completeness(spark, sf).select(F.lit("completeness"), "issue", F.col("n").cast("double")))
    out = out.union(profile.agg_dominance(spark, sf).select(F.lit("dominance"), "column", "percent"))
    return out.union(stats.stat_detect_all(spark, sf).select(F.lit("drift"), "feature", "statistic"))


# Thresholds of a run and their directions.
GATES = [("success_rate", "min", 0.7), ("anomaly_pct", "max", 25.0), ("drift_features", "max", 3.0), ("embedding_success", "min", 0.95), ("vectors", "min", 100.0)]


@query("dq_gate", """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END) AS success_rate, 100.0 * avg(CASE WHEN value > 100 THEN 1.0 ELSE 0 END) AS anomaly_pct, count(DISTINCT event_type)::DOUBLE AS drift_features, avg(CASE WHEN value > 2 THEN 1.0 ELSE 0 END) AS embedding_success, count(*)::DOUBLE AS vectors FROM events GROUP BY 1),
    l AS (""" + " UNION ALL ".join(f"SELECT day, '{m}' AS metric, round({m}, 6) AS value, CASE WHEN '{s}' = 'min' THEN {m} >= {t} ELSE {m} <= {t} END AS passed FROM d" for m, s, t in GATES) + ") SELECT * FROM l")
def dq_gate(spark, sf):
    rate = lambda c: F.avg(c.cast("double"))
    d = events(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(rate(F.col("event_type") != "error").alias("success_rate"), (100 * rate(F.col("value") > 100)).alias("anomaly_pct"), F.count_distinct("event_type").cast("double").alias("drift_features"), rate(F.col("value") > 2).alias("embedding_success"), F.count("*").cast("double").alias("vectors"))
    long = d.unpivot("day", [m for m, _, _ in GATES], "metric", "value")
    gates = spark.createDataFrame(GATES, "metric string, side string, threshold double")
    ok = F.when(F.col("side") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return long.join(F.broadcast(gates), "metric").select("day", "metric", r6(F.col("value")).alias("value"), ok.alias("passed"))  # five gates


