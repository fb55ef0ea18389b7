"""Queries of the aggregation and profiling operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import profile as P
from .base import LOG_SQL, events, log, query, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = ["l_returnflag", "l_linestatus"]


def _each(columns, body, tail=""):
    return " UNION ALL ".join(body.format(c=c) for c in columns) + tail


_STAT = "SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, count(*) - count({c}) AS missing FROM lineitem"


@query("agg_dataset_stats", _each(LINE, _STAT) + " UNION ALL " + _each(FLAGS, "SELECT '{c}' AS \"column\", count({c}) AS n, NULL AS mean, NULL AS std, NULL AS min, count(DISTINCT {c})::DOUBLE AS max, count(*) - count({c}) AS missing FROM lineitem"))
def agg_dataset_stats(spark, sf):
    df = table(spark, sf, "lineitem")
    text = P.text_stats(df, FLAGS).select("column", "n", *[F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min")], F.col("distinct").cast("double").alias("max"), "missing")
    return P.numeric_stats(df, LINE).unionByName(text)


@query("agg_top_values", "SELECT * FROM (" + _each(FLAGS, "SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}") + ") WHERE rank <= 10")
def agg_top_values(spark, sf):
    return P.value_counts(table(spark, sf, "lineitem"), FLAGS, 10)


ORDER_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string")]


@query("agg_schema_details", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, " + (f"NULL::DOUBLE AS min, NULL::DOUBLE AS max, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM orders WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples" if t == "string" else f"round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, NULL AS samples") + " FROM orders"
    for c, t in ORDER_COLS
))
def agg_schema_details(spark, sf):
    df = table(spark, sf, "orders").select(*[c for c, _ in ORDER_COLS])
    kinds = dict(df.dtypes)
    one = df.agg(*[x for c in df.columns for x in (F.count(c).alias(f"n_{c}"), F.count_if(F.col(c).isNull()).alias(f"m_{c}"), F.count_distinct(c).alias(f"d_{c}"), *([F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}")] if kinds[c] != "string" else []))])
    none = F.lit(None).cast("double")
    rows = [(c, [F.lit(kinds[c]), F.col(f"n_{c}"), F.col(f"m_{c}"), F.col(f"d_{c}"), none if kinds[c] == "string" else P.r6(F.col(f"lo_{c}")), none if kinds[c] == "string" else P.r6(F.col(f"hi_{c}"))]) for c in df.columns]
    facts = P.stacked(one, rows, ["dtype", "non_null", "nulls", "distinct_values", "min", "max"])
    text = [c for c in df.columns if kinds[c] == "string"]
    w = Window.partitionBy("column").orderBy("value")
    few = P.value_counts(df, text).withColumn("k", F.row_number().over(w)).filter("k <= 5").groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("samples"))
    return facts.join(F.broadcast(few), "column", "left")


INFER = ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"]


@query("agg_infer_schema", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN count(v) > 0 AND count(CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 1 END) = count(v) THEN 'int' WHEN count(v) > 0 AND count(try_cast(v AS DOUBLE)) = count(v) THEN 'float'
    WHEN count(try_cast(v AS TIMESTAMP)) * 2 > count(*) THEN 'datetime' WHEN count(v) > 0 AND count(CASE WHEN v LIKE '[%]' THEN 1 END) = count(v) THEN 'list' ELSE 'str' END AS logical_type FROM (SELECT CAST({c} AS VARCHAR) AS v FROM orders)"""
    for c in INFER
))
def agg_infer_schema(spark, sf):
    df = table(spark, sf, "orders").select(*[F.col(c).cast("string").alias(c) for c in INFER])
    one = df.agg(F.count("*").alias("n"), *[x for c in INFER for x in (
        F.count(c).alias(f"v_{c}"), F.count_if(F.col(c).rlike("^[+-]?[0-9]+$")).alias(f"i_{c}"), F.count(F.expr(f"try_cast({c} as double)")).alias(f"f_{c}"),
        F.count(F.expr(f"try_cast({c} as timestamp)")).alias(f"t_{c}"), F.count_if(F.col(c).rlike(r"(?s)^\[.*\]$")).alias(f"l_{c}"))])
    def kind(c):
        v = F.col(f"v_{c}")
        return (F.when((v > 0) & (F.col(f"i_{c}") == v), "int").when((v > 0) & (F.col(f"f_{c}") == v), "float").when(F.col(f"t_{c}") * 2 > F.col("n"), "datetime").when((v > 0) & (F.col(f"l_{c}") == v), "list").otherwise("str"))
    return P.stacked(one, [(c, [kind(c)]) for c in INFER], ["logical_type"])


@query("agg_baseline_stats", """
    SELECT 'n_chars' AS "column", 'numeric' AS kind, round(min(n_chars)::DOUBLE, 6) AS low, round(max(n_chars)::DOUBLE, 6) AS high, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, round(100.0 * (count(*) - count(n_chars)) / count(*), 6) AS null_pct FROM documents
    UNION ALL SELECT 'text', 'text', min(length(text))::DOUBLE, max(length(text))::DOUBLE, round(avg(length(text)), 6), NULL, round(100.0 * (count(*) - count(text)) / count(*), 6) FROM documents
    UNION ALL SELECT 'topics', 'list', min(len(t))::DOUBLE, max(len(t))::DOUBLE, round(avg(len(t)), 6), NULL, 0.0 FROM (SELECT string_split(text, chr(10)) AS t FROM documents)""")
def agg_baseline_stats(spark, sf):
    df = table(spark, sf, "documents").select("n_chars", "text", F.split("text", "\n").alias("topics"))
    return P_baseline(df)


def P_baseline(df):
    """Baseline statistics by kind of column; population std."""
    kinds = dict(df.dtypes)
    measure = {c: F.size(c) if k.startswith("array") else F.char_length(c) if k == "string" else F.col(c) for c, k in kinds.items()}
    measure = {c: F.when(F.col(c).isNotNull(), m) for c, m in measure.items()}
    one = df.agg(F.count("*").alias("n"), *[x for c, m in measure.items() for x in (F.count(m).alias(f"c_{c}"), F.min(m).alias(f"lo_{c}"), F.max(m).alias(f"hi_{c}"), F.avg(m).alias(f"mean_{c}"), F.stddev_pop(m).alias(f"std_{c}"))])
    kind = lambda k: "list" if k.startswith("array") else "text" if k == "string" else "numeric"
    rows = [(c, [F.lit(kind(k)), P.r6(F.col(f"lo_{c}")), P.r6(F.col(f"hi_{c}")), P.r6(F.col(f"mean_{c}")), P.r6(F.col(f"std_{c}")) if kind(k) == "numeric" else F.lit(None).cast("double"), P.r6(100 * (F.col("n") - F.col(f"c_{c}")) / F.col("n")), F.col(f"c_{c}")]) for c, k in kinds.items() if c != "error"]
    return P.stacked(one, rows, ["kind", "low", "high", "mean", "std", "null_pct", "k"]).filter("k > 0").drop("k")


@query("agg_baseline_build")
def agg_baseline_build(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    cut = P.quantiles(df, "doc_id", [0.7]).select(F.col("q")[0].alias("cut"))
    df = df.join(F.broadcast(cut)).withColumn("side", F.when(F.col("doc_id") <= F.col("cut"), "train").otherwise("validation"))
    sizes = df.groupBy("side").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("side", "n")))).alias("sizes"))
    stats = P_baseline(df.filter("side = 'train'").select("n_chars", "text")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("column", "kind", "low", "high", "mean", "std", "null_pct")))).alias("stats"))
    schema = ",".join(f"{c}:{t}" for c, t in df.drop("cut", "side").dtypes)
    train = df.filter("side = 'train'").agg(F.bool_and(F.col("doc_id").isNotNull()).alias("ids"), (F.count("text") > 0).alias("text"), (F.count_if(F.col("n_chars") > 0) * 2 > F.count("*")).alias("n_chars"))
    checks = train.select(F.to_json(F.struct("ids", "n_chars", "text")).alias("checks"))
    # one row each
    return sizes.join(F.broadcast(stats)).join(F.broadcast(checks)).select(F.to_json("sizes").alias("sizes"), "stats", F.lit(schema).alias("schema"), "checks")


@query("agg_overview", "SELECT count(*) AS n_rows, 3::BIGINT AS n_columns, count(*) - count(DISTINCT (user_id, event_type, props)) AS duplicate_rows FROM events")
def agg_overview(spark, sf):
    df = events(spark, sf).select("user_id", "event_type", "props")
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("k"))
    return groups.agg(F.sum("k").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), (F.sum("k") - F.count("*")).alias("duplicate_rows"))


@query("agg_missing", """WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) SELECT * FROM (
    SELECT 'quality' AS "column", count(*) - count(quality) AS missing, round(100.0 * (count(*) - count(quality)) / count(*), 2) AS percent FROM d
    UNION ALL SELECT 'toxic', count(*) - count(toxic), round(100.0 * (count(*) - count(toxic)) / count(*), 2) FROM d
    UNION ALL SELECT 'lang', count(*) - count(lang), round(100.0 * (count(*) - count(lang)) / count(*), 2) FROM d) WHERE missing > 0""")
def agg_missing(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    cols = ["quality", "toxic", "lang"]
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return P.stacked(one, [(c, [F.col(c), F.round(100 * F.col(c) / F.col("n"), 2)]) for c in cols], ["missing", "percent"]).filter("missing > 0")


@query("agg_numeric_profile", _each(["l_quantity", "l_extendedprice"], "SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.75), 6) AS q75, round(skewness({c}), 5) AS skewness, round(kurtosis({c}), 5) AS kurtosis FROM lineitem"))
def agg_numeric_profile(spark, sf):
    return P.moments(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("agg_iqr_outliers", _each(["l_quantity", "l_extendedprice"], "SELECT '{c}' AS \"column\", round(any_value(lo), 6) AS lower, round(any_value(hi), 6) AS upper, count(CASE WHEN {c} < lo OR {c} > hi THEN 1 END) AS outliers, round(100.0 * count(CASE WHEN {c} < lo OR {c} > hi THEN 1 END) / count({c}), 6) AS percent FROM lineitem, (SELECT q[1] - 1.5 * (q[2] - q[1]) AS lo, q[2] + 1.5 * (q[2] - q[1]) AS hi FROM (SELECT quantile_cont({c}, [0.25, 0.75]) AS q FROM lineitem))"))
def agg_iqr_outliers(spark, sf):
    return P.iqr_outliers(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("agg_categorical_profile", _each(["o_orderstatus", "o_orderpriority"], "SELECT '{c}' AS \"column\", count(*) AS \"distinct\", arg_min(v, (-n, v)) AS mode, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT {c} AS v, count(*) AS n, sum(count(*)) OVER () AS t FROM orders WHERE {c} IS NOT NULL GROUP BY 1)"))
def agg_categorical_profile(spark, sf):
    return P.categorical_profile(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("agg_correlation", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, abs(round(corr({a}, {b}), 6)) > 0.5 AS high FROM lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1:]))
def agg_correlation(spark, sf):
    return P.correlations(table(spark, sf, "lineitem"), LINE)


@query("agg_histogram", """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS k FROM orders, e GROUP BY 1)
    SELECT b.bin, round(lo + (hi - lo) / 20 * b.bin, 6) AS "from", round(lo + (hi - lo) / 20 * (b.bin + 1), 6) AS "to", coalesce(k, 0) AS n FROM (SELECT unnest(range(20))::INTEGER AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin""")
def agg_histogram(spark, sf):
    return P.histogram(table(spark, sf, "orders"), "o_totalprice")


@query("agg_dominance", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", arg_min(v, (-n, v)) AS value, round(100.0 * max(n) / sum(n), 6) AS percent FROM (SELECT {c} AS v, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY 1)" for c in ("lang", "source")))
def agg_dominance(spark, sf):
    counts = P.value_counts(table(spark, sf, "documents"), ["lang", "source"])
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"), P.r6(100 * F.max("n") / F.sum("n")).alias("percent"))


@query("agg_top_topics", "SELECT topic, n, CAST(row_number() OVER (ORDER BY n DESC, topic) AS INTEGER) AS rank FROM (SELECT topic, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS topic FROM documents) GROUP BY 1) ORDER BY rank LIMIT 5")
def agg_top_topics(spark, sf):
    topics = table(spark, sf, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("topic"))
    top = topics.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(5)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "topic")))  # five rows


@query("agg_recency", "SELECT count(o_orderdate) AS valid, " + ", ".join(f"count(CASE WHEN date_diff('day', o_orderdate::DATE, DATE '2001-08-01') <= {d} THEN 1 END) AS within_{d}" for d in (30, 90, 365)) + ", count(CASE WHEN date_diff('day', o_orderdate::DATE, DATE '2001-08-01') > 365 THEN 1 END) AS older FROM orders")
def agg_recency(spark, sf, as_of="2001-08-01"):
    age = F.datediff(F.lit(as_of).cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").agg(F.count("o_orderdate").alias("valid"), *[F.count_if(age <= d).alias(f"within_{d}") for d in (30, 90, 365)], F.count_if(age > 365).alias("older"))


@query("agg_scrape_metrics", "SELECT tld, count(*) AS total, count(html) AS fetched, count(CASE WHEN html LIKE '%<h1>%' THEN 1 END) AS with_title, count(CASE WHEN tld <> 'com' THEN 1 END) AS with_country, round(count(html) / count(*), 6) AS success_rate FROM (SELECT *, regexp_extract(lower(url), '^[a-z]+://[^/:?#]*[.]([a-z]+)', 1) AS tld FROM pages) GROUP BY tld")
def agg_scrape_metrics(spark, sf):
    df = table(spark, sf, "pages").withColumn("tld", F.regexp_extract(F.lower("url"), r"^[a-z]+://[^/:?#]*[.]([a-z]+)", 1))
    return df.groupBy("tld").agg(F.count("*").alias("total"), F.count("html").alias("fetched"), F.count_if(F.col("html").contains("<h1>")).alias("with_title"), F.count_if(F.col("tld") != "com").alias("with_country"), P.r6(F.try_divide(F.count("html"), F.count("*"))).alias("success_rate"))


@query("agg_class_distribution", "SELECT lang AS split, source AS class, count(*) AS n FROM documents GROUP BY ALL")
def agg_class_distribution(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("split"), F.col("source").alias("class")).agg(F.count("*").alias("n"))


@query("agg_image_summary", "SELECT CASE WHEN grouping(fmt) = 0 THEN 'format' WHEN grouping(mode) = 0 THEN 'mode' ELSE 'all' END AS part, coalesce(fmt, mode, '') AS value, count(*) AS n, min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS mean_size, round(stddev_pop(size), 6) AS std_size, count(DISTINCT size) AS sizes FROM (SELECT split_part(url, ':', 1) AS fmt, regexp_extract(url, '/(en|de|fr|es)/', 1) AS mode, length(html)::BIGINT AS size FROM pages) GROUP BY GROUPING SETS ((fmt), (mode), ())")
def agg_image_summary(spark, sf):
    df = table(spark, sf, "pages").select(F.split("url", ":")[0].alias("fmt"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("mode"), F.char_length("html").cast("long").alias("size"))
    out = df.groupingSets([[F.col("fmt")], [F.col("mode")], []], "fmt", "mode").agg(F.grouping("fmt").alias("gf"), F.grouping("mode").alias("gm"), F.count("*").alias("n"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), P.r6(F.avg("size")).alias("mean_size"), P.r6(F.stddev_pop("size")).alias("std_size"), F.count_distinct("size").alias("sizes"))
    return out.select(F.when(F.col("gf") == 0, "format").when(F.col("gm") == 0, "mode").otherwise("all").alias("part"), F.coalesce("fmt", "mode", F.lit("")).alias("value"), "n", "min_size", "max_size", "mean_size", "std_size", "sizes")


@query("agg_group_feature", "SELECT c_mktsegment AS grp, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max, count(c_acctbal) AS n FROM customer GROUP BY 1")
def agg_group_feature(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("grp")).agg(P.r6(F.avg("c_acctbal")).alias("mean"), P.r6(F.stddev_samp("c_acctbal")).alias("std"), F.min("c_acctbal").alias("min"), F.max("c_acctbal").alias("max"), F.count("c_acctbal").alias("n"))


@query("agg_crosstab", "SELECT event_type AS a, user_id % 4 AS b, count(*) AS n FROM events GROUP BY ALL")
def agg_crosstab(spark, sf):
    return events(spark, sf).groupBy(F.col("event_type").alias("a"), (F.col("user_id") % 4).alias("b")).agg(F.count("*").alias("n"))


PERF_SQL = """count(*) AS n, round(coalesce(avg(CASE WHEN success THEN 0.0 ELSE 1.0 END), 0), 6) AS error_rate, round(coalesce(avg(latency) FILTER (success), 0), 6) AS avg_latency, round(coalesce(quantile_cont(latency, 0.95) FILTER (success), 0), 6) AS p95_latency,
    round(coalesce(avg(relevance), 0), 6) AS avg_relevance, round(avg(composite), 6) AS avg_composite, round(min(composite), 6) AS min_composite, round(avg(groundedness), 6) AS avg_groundedness, round(avg(retrieval), 6) AS avg_retrieval, count(DISTINCT doc_id) AS distinct_docs, round(coalesce(100 * count(DISTINCT doc_id) / avg(index_size), 0), 2) AS coverage"""


@query("agg_perf_metrics", LOG_SQL + f"SELECT {PERF_SQL} FROM log")
def agg_perf_metrics(spark, sf):
    return P.perf_metrics(log(spark, sf))


@query("agg_qa_eval", LOG_SQL + "SELECT count(*) AS n, count(CASE WHEN NOT success THEN 1 END) AS failed, round(100.0 * count(CASE WHEN success THEN 1 END) / count(*), 6) AS success_pct, round(coalesce(avg(composite), 0), 6) AS avg_composite, round(coalesce(avg(latency) FILTER (success), 0), 6) AS avg_runtime FROM log")
def agg_qa_eval(spark, sf):
    return log(spark, sf).agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failed"), P.r6(100 * F.count_if("success") / F.count("*")).alias("success_pct"), P.r6(F.coalesce(F.avg("composite"), F.lit(0.0))).alias("avg_composite"), P.r6(F.coalesce(F.avg(F.when(F.col("success"), F.col("latency"))), F.lit(0.0))).alias("avg_runtime"))


_GRID = "SELECT a.c AS truth, b.c AS predicted, count(l.doc_id) AS n FROM (SELECT DISTINCT unnest([quality, toxic]) AS c FROM labels) a CROSS JOIN (SELECT DISTINCT unnest([quality, toxic]) AS c FROM labels) b LEFT JOIN labels l ON l.quality = a.c AND l.toxic = b.c GROUP BY ALL"


@query("agg_confusion", _GRID)
def agg_confusion(spark, sf):
    return P.confusion(table(spark, sf, "labels"), "quality", "toxic")


_CLASS = f"""WITH m AS ({_GRID}), s AS (SELECT c AS class, sum(CASE WHEN truth = c THEN n ELSE 0 END)::BIGINT AS support, sum(CASE WHEN predicted = c THEN n ELSE 0 END)::BIGINT AS called, sum(CASE WHEN truth = c AND predicted = c THEN n ELSE 0 END)::BIGINT AS tp FROM m, (SELECT DISTINCT truth AS c FROM m) GROUP BY c),
    k AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE tp / called END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r FROM s),
    o AS (SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, tp FROM k)"""


@query("agg_class_metrics", _CLASS + " SELECT * FROM o")
def agg_class_metrics(spark, sf):
    return P.class_metrics(table(spark, sf, "labels"), "quality", "toxic")


@query("agg_weighted_metrics", _CLASS + " SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM o")
def agg_weighted_metrics(spark, sf):
    return P.weighted_metrics(P.class_metrics(table(spark, sf, "labels"), "quality", "toxic"))


@query("agg_auc", "WITH d AS (SELECT n_chars AS v, sum(quality) AS pos, sum(1 - quality) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d) SELECT round(sum(pos * (b + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM r")
def agg_auc(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return P.auc(df, "n_chars", F.col("quality") == 1)


_OVR = ["en", "de", "es", "fr"]


@query("agg_auc_ovr", "WITH d AS (SELECT lang, n_chars FROM documents WHERE lang IS NOT NULL), s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS class, (n_chars * {i + 3}) % 101 AS v, (lang = '{c}')::INT AS pos FROM d" for i, c in enumerate(_OVR)) + "), g AS (SELECT class, v, sum(pos) AS pos, sum(1 - pos) AS neg FROM s GROUP BY ALL), r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g), a AS (SELECT class, sum(pos)::BIGINT AS support, round(coalesce(sum(pos * (b + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 0), 6) AS auc FROM r GROUP BY 1) SELECT * FROM a UNION ALL SELECT 'weighted', sum(support)::BIGINT, round(sum(auc * support) / sum(support), 6) FROM a")
def agg_auc_ovr(spark, sf):
    """Several classes, one against the rest, weighted by support."""
    d = table(spark, sf, "documents").select("lang", "n_chars").filter("lang is not null")
    scored = d.select("lang", *[((F.col("n_chars") * (i + 3)) % 101).alias(f"score_{c}") for i, c in enumerate(_OVR)])
    return P.auc_ovr(scored, "lang", {c: f"score_{c}" for c in _OVR})
