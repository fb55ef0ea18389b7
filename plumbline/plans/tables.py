"""Queries of sources, sinks, joins, ranks and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType, TimestampType

from ..operators import tables as TB
from ..operators.profile import quantiles, r6
from ..shared import fresh_path
from ..sources import files as S
from ..sources import schemas as C
from ..sources import versions as V
from .base import LOG_SQL, events, log, query, retrainings, table
from .text import PAIRS_SQL, pairs


@query("src_jsonl", "SELECT doc_id, lang, strftime(TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * (doc_id % 1000)::INTEGER, '%Y-%m-%d') AS published, md5(text) AS text_md5 FROM documents WHERE doc_id % 10 NOT IN (3, 4)")
def src_jsonl(spark, sf):
    d = table(spark, sf, "documents").withColumn("published", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")).cast("string"))
    line = F.to_json(F.struct("doc_id", "lang", "published", "text", F.when(F.col("doc_id") % 10 == 4, "timeout").alias("error")))
    path = fresh_path(spark, "jsonl")
    d.select(F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("{broken"), line)).otherwise(line).alias("value")).write.text(path)
    got = S.read_jsonl(spark, path, StructType().add("doc_id", LongType()).add("lang", StringType()).add("published", StringType()).add("text", StringType()))
    return got.select("doc_id", "lang", F.date_format("published", "yyyy-MM-dd").alias("published"), F.md5("text").alias("text_md5"))


_ORDERS = StructType().add("o_orderkey", LongType()).add("o_custkey", LongType()).add("o_totalprice", DoubleType()).add("o_orderdate", TimestampType())


def order_files(spark, sf):
    """Orders as CSV files, one for each quarter's partition, and some in a folder that is none."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").withColumn("q", F.date_trunc("quarter", "o_orderdate"))
    path = fresh_path(spark, "csv")
    days = o.select("*", F.date_format("q", "yyyy").alias("y"), F.date_format("q", "MM").alias("m"), F.date_format("q", "dd").alias("d")).drop("q")
    days.filter("o_orderkey % 50 <> 0").repartition("y", "m", "d").write.partitionBy("y", "m", "d").option("header", True).csv(path)
    days.filter("o_orderkey % 50 = 0").drop("y", "m", "d").coalesce(1).write.option("header", True).csv(path + "/misc")
    return path


_QUARTER = "date_trunc('quarter', o_orderdate)"


@query("src_partition_list", f"SELECT strftime({_QUARTER}, '%Y-%m-%dT00:00:00') AS partition_timestamp, strftime({_QUARTER}, '%Y/%m/%d') AS partition_path, 1::BIGINT AS files FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY ALL")
def src_partition_list(spark, sf):
    found = TB.partitions(S.list_files(spark, order_files(spark, sf)))
    return found.select(F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss").alias("partition_timestamp"), F.date_format("day", "yyyy/MM/dd").alias("partition_path"), "files")


@query("src_partition_latest", "SELECT CASE d WHEN 1 THEN 'new' ELSE 'baseline' END AS role, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM (SELECT *, dense_rank() OVER (ORDER BY o_orderdate DESC) AS d FROM orders) WHERE d <= 2 GROUP BY ALL")
def src_partition_latest(spark, sf):
    rows = TB.latest(table(spark, sf, "orders"), "o_orderdate")
    return rows.groupBy(F.when(F.col("age") == 1, "new").otherwise("baseline").alias("role"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), r6(F.sum("o_totalprice")).alias("total"))


@query("src_partition_load", f"SELECT strftime({_QUARTER}, '%Y/%m/%d') AS partition_path, strftime({_QUARTER}, '%Y-%m-%d') AS partition_day, count(*) AS n, round(sum(o_totalprice), 3) AS total, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY ALL")
def src_partition_load(spark, sf):
    got = S.read_partitions(spark, order_files(spark, sf), _ORDERS)
    return got.groupBy(F.col("_partition_path").alias("partition_path"), F.date_format("_partition_timestamp", "yyyy-MM-dd").alias("partition_day")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 3).alias("total"), F.count_distinct("o_custkey").alias("customers"))


@query("snk_partition_write", "SELECT 'lineitem' AS dataset, year(l_shipdate)::INTEGER AS y, month(l_shipdate)::INTEGER AS m, count(*) AS rows, 11::BIGINT AS columns FROM lineitem GROUP BY ALL")
def snk_partition_write(spark, sf):
    """Even years, then odd ones, then one year once more: all partitions stay, and so does their catalogue."""
    path, li, year = fresh_path(spark, "partitioned"), table(spark, sf, "lineitem"), F.year("l_shipdate")
    for some in (year % 2 == 0, year % 2 == 1, year == 1995):
        S.write_partitions(li.filter(some), path, "l_shipdate", "lineitem")
    kept = spark.read.parquet(path).groupBy("dataset", "y", "m").agg(F.count("*").alias("rows"))
    return kept.join(S.partition_catalogue(spark, path), ["dataset", "y", "m", "rows"], "full")


@query("snk_versioned", """SELECT 2::BIGINT AS version, p_brand, count(*) AS n, round(sum(p_retailprice), 3) AS total FROM part GROUP BY p_brand
    UNION ALL SELECT 1, p_brand, count(*), round(sum(p_retailprice), 3) FROM part WHERE p_size < 25 GROUP BY p_brand""")
def snk_versioned(spark, sf):
    """A table published twice: the latest version, which its pointer names, and the first."""
    path, part = fresh_path(spark, "versions"), table(spark, sf, "part")
    first = V.publish(part.filter("p_size < 25"), path)
    V.publish(part, path)
    sums = lambda df, n: df.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 3).alias("total")).select(F.lit(n).cast("long").alias("version"), "p_brand", "n", "total")
    return sums(V.read(spark, path), V.latest(spark, path)).union(sums(V.read(spark, path, first), first))


_LINE = "CASE page_id % 6 WHEN 0 THEN '# ' || url WHEN 1 THEN '  ' || url || ' ' WHEN 2 THEN '' WHEN 3 THEN 'ftp://x' ELSE url END"


@query("src_url_list", f"SELECT trim({_LINE}) AS url, count(*) AS n FROM pages WHERE trim({_LINE}) LIKE 'http%' GROUP BY 1")
def src_url_list(spark, sf):
    k = F.col("page_id") % 6
    line = F.when(k == 0, F.concat(F.lit("# "), "url")).when(k == 1, F.concat(F.lit("  "), "url", F.lit(" "))).when(k == 2, "").when(k == 3, "ftp://x").otherwise(F.col("url"))
    return S.url_lines(table(spark, sf, "pages").select(line.alias("value"))).groupBy("url").agg(F.count("*").alias("n"))


@query("src_url_merge", "SELECT url, bool_and(page_id % 3 = 0) AS added FROM pages GROUP BY url")
def src_url_merge(spark, sf):
    """A list that is stored in versions; a second one adds to it, and a third has nothing new."""
    path, p = fresh_path(spark, "urls"), table(spark, sf, "pages")
    V.add_urls(spark, path, p.filter("page_id % 3 <> 0"))
    second = V.add_urls(spark, path, p.filter("page_id % 3 = 0"))
    V.add_urls(spark, path, p)
    return V.read(spark, path).select("url", (F.col("version") == F.lit(second)).alias("added"))


@query("src_next_version", "SELECT p_brand AS prefix, max(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_size END)::BIGINT + 1 AS next_version FROM part GROUP BY 1")
def src_next_version(spark, sf):
    name = F.concat("p_brand", F.lit("/model_"), F.when(F.col("p_partkey") % 3 == 0, "latest").otherwise(F.concat(F.lit("v"), F.col("p_size").cast("string"))))
    return S.next_version(table(spark, sf, "part").withColumn("name", name), "name", F.substring_index("name", "/", 1))


_SEG = "regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '/([a-z]{2})/[^/]+/?$', 1)"


@query("src_file_inventory", f"SELECT page_id, class, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY md5(url), page_id) <= 0.8 * count(*) OVER (PARTITION BY class) THEN 'train' ELSE 'test' END AS split FROM (SELECT page_id, url, {_SEG} AS class FROM (SELECT max(page_id) AS page_id, url FROM pages GROUP BY url)) WHERE class <> ''")
def src_file_inventory(spark, sf):
    files = table(spark, sf, "pages").groupBy("url").agg(F.max("page_id").alias("page_id"))
    files = files.withColumn("class", F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "/([a-z]{2})/[^/]+/?$", 1)).filter("class <> ''")
    ranked = TB.salted_rank(files, ["class"], F.md5("url"))
    return ranked.select("page_id", "class", F.when(F.col("rank") <= 0.8 * F.col("group_size"), "train").otherwise("test").alias("split"))


@query("src_qa_pairs", f"WITH {PAIRS_SQL} SELECT conv_id, turn, md5(trim(question)) AS question_md5, md5(trim(answer)) AS answer_md5 FROM pair WHERE conv_id % 5 <> 4")
def src_qa_pairs(spark, sf):
    k = F.col("conv_id") % 5
    j = lambda a, b: F.to_json(F.struct(F.col("question").alias(a), F.col("answer").alias(b)))
    record = F.when(k == 0, j("Q", "A")).when(k == 1, j("question", "response")).when(k == 2, j("query", "completion")).when(k == 3, j("prompt", "answer")).otherwise(j("question", "other"))
    return S.qa_pairs(pairs(spark, sf).select("conv_id", "turn", record.alias("value"))).select("conv_id", "turn", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query("src_prediction_log", "WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_id, event_type <> 'error' AS success, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS latency, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS response_time, round(value % 1, 6) AS composite_score, 2 AS num_docs, 500::BIGINT AS index_size FROM events, m WHERE event_type <> 'view' AND ts > m.t - INTERVAL 24 HOUR ORDER BY ts DESC, event_id DESC LIMIT 10000")
def src_prediction_log(spark, sf):
    e = events(spark, sf)
    body = F.struct((F.col("event_type") != "error").alias("success"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("latency"), (F.col("value") % 1).alias("composite_score"), F.array(F.struct(F.lit(1).alias("doc_id"), F.lit(0.5).alias("score")), F.struct(F.lit(2).alias("doc_id"), F.lit(0.25).alias("score"))).alias("retrieved"), F.lit(500).alias("index_size"))
    rows = e.select("event_id", "ts", F.to_json(F.struct(F.when(F.col("event_type") != "view", body).alias("prediction_result"))).alias("payload"))
    until = e.agg(F.max("ts").alias("until"))
    got = S.prediction_log(rows.join(F.broadcast(until)), "payload", "ts", F.col("until"))
    return got.select("event_id", "success", "latency", "response_time", r6(F.col("composite_score")).alias("composite_score"), "num_docs", "index_size")


@query("snk_report_rollup", """WITH r AS (SELECT l_returnflag || '_' || k AS report, count(*) AS n, list(l_orderkey * 10 + l_linenumber ORDER BY l_orderkey * 10 + l_linenumber)[1:5] AS d FROM (SELECT *, 'validation' AS k FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT *, 'drift' FROM lineitem WHERE l_discount > 0.09) GROUP BY 1)
    SELECT count(*) AS reports, sum(n)::BIGINT AS issues, string_agg(report || ':' || array_to_string(d, ','), ';' ORDER BY report) AS details, bool_or(n > 0) AS alert FROM r""")
def snk_report_rollup(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    kinds = F.array_compact(F.array(F.when(F.col("l_quantity") > 49, "validation"), F.when(F.col("l_discount") > 0.09, "drift")))
    issues = li.select(F.explode(kinds).alias("kind"), "l_returnflag", "row").withColumn("report", F.concat_ws("_", "l_returnflag", "kind"))
    # the five first details of each report, by a window that keeps five per task
    few = issues.withColumn("k", F.row_number().over(Window.partitionBy("report").orderBy("row"))).filter("k <= 5").groupBy("report").agg(F.sort_array(F.collect_list("row")).alias("d"))
    counts = issues.groupBy("report").agg(F.count("*").alias("n")).join(few, "report")
    line = F.concat("report", F.lit(":"), F.array_join(F.transform("d", lambda x: x.cast("string")), ","))
    return counts.agg(F.count("*").alias("reports"), F.sum("n").alias("issues"), F.array_join(F.sort_array(F.collect_list(line)), ";").alias("details"), F.bool_or(F.col("n") > 0).alias("alert"))


@query("src_log_record", LOG_SQL + "SELECT event_id, success, round(CASE WHEN success THEN 0.5 * retrieval + 0.5 * groundedness END, 4) AS composite, CASE WHEN success THEN 1 ELSE 0 END AS n_docs, CASE WHEN success THEN 4 ELSE 2 END AS n_keys FROM log")
def src_log_record(spark, sf):
    rec = F.to_json(F.struct(
        "success", "latency", F.when(F.col("success"), F.round(0.5 * F.col("retrieval") + 0.5 * F.col("groundedness"), 4)).alias("composite_score"),
        F.when(F.col("success"), F.array(F.struct("doc_id", F.round("retrieval", 4).alias("score")))).alias("retrieved_docs"),
    ))
    r = log(spark, sf).select("event_id", rec.alias("j"))
    return r.select("event_id", F.get_json_object("j", "$.success").cast("boolean").alias("success"), F.get_json_object("j", "$.composite_score").cast("double").alias("composite"), F.coalesce(F.json_array_length(F.get_json_object("j", "$.retrieved_docs")), F.lit(0)).alias("n_docs"), F.size(F.json_object_keys("j")).alias("n_keys"))


@query("join_left_attr", "SELECT c_custkey, o_orderkey, o_totalprice, o_orderkey IS NOT NULL AS matched FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left_attr(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice", F.col("o_orderkey").isNotNull().alias("matched"))


_FILE = "CASE s_suppkey % 8 WHEN 0 THEN s_name || '.jpg' WHEN 1 THEN upper(s_name) || '.png' WHEN 2 THEN s_name || '_left.jpg' WHEN 3 THEN s_name WHEN 4 THEN substr(lower(s_name), 3) || '.jpg' WHEN 5 THEN 'Scan-' || s_suppkey || '-end.dcm' WHEN 6 THEN 'scan-' || s_suppkey || '-end.tif' ELSE 'none' || s_suppkey END"


@query("join_cascade", f"""WITH f AS (SELECT s_suppkey AS file_id, {_FILE} AS name FROM supplier), m AS (SELECT s_suppkey AS pos, s_name AS key, 'raw/scan-' || s_suppkey || '-end.dcm' AS path FROM supplier), g AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM f),
    j AS (SELECT file_id, pos, key, CASE WHEN key = stem THEN 1 WHEN key = name THEN 2 WHEN upper(key) = upper(stem) THEN 3 WHEN contains(lower(key), lower(stem)) THEN 4 WHEN starts_with(stem, key) OR starts_with(key, stem) THEN 5 WHEN contains(lower(path), lower(name)) THEN 6 WHEN contains(lower(path), lower(stem)) THEN 7 END AS strategy FROM g, m)
    SELECT file_id, strategy, pos, key FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY strategy, pos) AS r FROM j WHERE strategy IS NOT NULL) WHERE r = 1""")
def join_cascade(spark, sf):
    s = table(spark, sf, "supplier")
    k, n = F.col("s_suppkey") % 8, F.col("s_suppkey").cast("string")
    add = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    own = F.col("s_name")
    name = F.when(k == 0, add(own, ".jpg")).when(k == 1, add(F.upper(own), ".png")).when(k == 2, add(own, "_left.jpg")).when(k == 3, own).when(k == 4, add(F.substring(F.lower(own), 3, 1000), ".jpg")).when(k == 5, add("Scan-", n, "-end.dcm")).when(k == 6, add("scan-", n, "-end.tif")).otherwise(add("none", n))
    meta = s.select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("key"), add("raw/scan-", n, "-end.dcm").alias("path"))
    return TB.cascade(s.select(F.col("s_suppkey").alias("file_id"), name.alias("name")), meta)


@query("join_align", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL")
def join_align(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id").dropna(subset=["lang", "quality"])


@query("join_category_align", "SELECT o_orderpriority AS value, count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS base_n, count(CASE WHEN o_orderkey % 2 = 1 THEN 1 END) AS new_n FROM orders GROUP BY 1")
def join_category_align(spark, sf):
    o = table(spark, sf, "orders")
    return TB.aligned_counts(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "o_orderpriority")


@query("join_stats_broadcast", "WITH s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM documents) SELECT doc_id, round((n_chars - m) / d, 6) AS z, n_chars > m + 2 * d AS beyond FROM documents, s")
def join_stats_broadcast(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    s = d.agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("d"))  # one row
    return d.join(F.broadcast(s)).select("doc_id", r6((F.col("n_chars") - F.col("m")) / F.col("d")).alias("z"), (F.col("n_chars") > F.col("m") + 2 * F.col("d")).alias("beyond"))


# Columns of the partition of a year: one that changes its type, one that comes and goes, one that is new.
_YEARS = "(SELECT year(l_shipdate)::VARCHAR AS day, year(l_shipdate) AS y, count(*) AS rows FROM lineitem GROUP BY ALL)"
_CATALOGUE_SQL = f"""SELECT 'lineitem' AS dataset, day, unnest(['l_orderkey', 'l_quantity']) AS "column", unnest(['bigint', CASE WHEN y < 1995 THEN 'double' ELSE 'int' END]) AS dtype, rows FROM {_YEARS}
    UNION ALL SELECT 'lineitem', day, 'l_tax', 'double', rows FROM {_YEARS} WHERE y % 3 = 0
    UNION ALL SELECT 'lineitem', day, 'l_shipmode', 'string', rows FROM {_YEARS} WHERE y > 1996"""


def yearly(spark, sf) -> str:
    """``lineitem`` written year by year, in columns that change; the folder."""
    path = fresh_path(spark, "yearly")
    li = table(spark, sf, "lineitem")
    years = [r[0] for r in li.select(F.year("l_shipdate")).distinct().collect()]  # few
    for y in sorted(years):
        quantity = F.col("l_quantity") if y < 1995 else F.col("l_quantity").cast("int").alias("l_quantity")
        more = ["l_tax"] * (y % 3 == 0) + [F.lit("AIR").alias("l_shipmode")] * (y > 1996)
        li.filter(F.year("l_shipdate") == y).select("l_orderkey", quantity, *more).write.parquet(f"{path}/day={y}")
    return path


@query("src_schema_catalogue", _CATALOGUE_SQL)
def src_schema_catalogue(spark, sf):
    """The columns of all partitions, from the footers of their files."""
    return C.catalogue(C.footers(spark, yearly(spark, sf)), "lineitem")


@query("join_schema_diff", f"""WITH c AS ({_CATALOGUE_SQL}), d AS (SELECT day, row_number() OVER (ORDER BY day) AS nth FROM (SELECT DISTINCT day FROM c)),
    grid AS (SELECT d.day, d.nth, k."column", c.dtype FROM d CROSS JOIN (SELECT DISTINCT "column" FROM c) k LEFT JOIN c ON c.day = d.day AND c."column" = k."column"),
    before AS (SELECT *, lag(dtype) OVER w AS prev, last_value(dtype IGNORE NULLS) OVER (PARTITION BY "column" ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM grid WINDOW w AS (PARTITION BY "column" ORDER BY nth))
    SELECT 'lineitem' AS dataset, day, "column", held AS old, dtype AS new,
           CASE WHEN held IS NULL THEN 'added' WHEN dtype IS NULL THEN 'removed' WHEN prev IS NULL THEN 'returned' ELSE 'type_changed' END AS change
    FROM before WHERE nth > 1 AND dtype IS DISTINCT FROM prev""")
def join_schema_diff(spark, sf):
    """What each partition's columns change against the partition before it."""
    return C.history(C.catalogue(C.footers(spark, yearly(spark, sf)), "lineitem"))


@query("join_last_before", LOG_SQL + "SELECT event_id, event_type, retraining, round(epoch(e.ts - retrained_at) / 86400, 6) AS days_since FROM events e ASOF LEFT JOIN retrainings r ON e.ts >= r.ts")
def join_last_before(spark, sf):
    """Each event with the last retraining before it."""
    e = TB.last_before(events(spark, sf).select("event_id", "event_type", "ts"), retrainings(spark, sf), "ts", [], ["retraining", "retrained_at"])
    micros = lambda c: F.unix_micros(F.col(c)) / 1e6
    return e.select("event_id", "event_type", "retraining", r6((micros("ts") - micros("retrained_at")) / 86400).alias("days_since"))


@query("join_setdiff", "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type <> 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT user_id, 'missing' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT user_id, 'new' FROM (FROM b EXCEPT FROM a)")
def join_setdiff(spark, sf):
    e = events(spark, sf)
    c = TB.aligned_counts(e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'"), "user_id")
    return c.filter("base_n = 0 or new_n = 0").select(F.col("value").alias("user_id"), F.when(F.col("new_n") == 0, "missing").otherwise("new").alias("side"))


@query("smp_stratified", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || '42')) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= greatest(1, floor(n * 0.1))")
def smp_stratified(spark, sf, share=0.1, seed=42):
    d = TB.salted_rank(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(str(seed)))))
    return d.filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("group_size") * share))).select("doc_id", "lang")


@query("smp_dryrun", "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'train' WHEN doc_id % 4 = 2 THEN 'val' ELSE 'test' END AS split FROM documents) SELECT doc_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(doc_id::VARCHAR)) AS r FROM s) WHERE r <= CASE split WHEN 'train' THEN 50 ELSE 25 END")
def smp_dryrun(spark, sf, most=100):
    k = F.col("doc_id") % 4
    d = table(spark, sf, "documents").select("doc_id", F.when(k < 2, "train").when(k == 2, "val").otherwise("test").alias("split"))
    # no split is ranked in one task: the digest's first digits part it, as in any stratified sample
    d = TB.salted_rank(d, ["split"], F.md5(F.col("doc_id").cast("string")))
    return d.filter(F.col("rank") <= F.when(F.col("split") == "train", most // 2).otherwise(most // 4)).select("doc_id", "split")


@query("win_split", "WITH c AS (SELECT quantile_disc(doc_id, 0.7) AS c FROM documents) SELECT doc_id, CASE WHEN doc_id <= c THEN 'train' ELSE 'validation' END AS side FROM documents, c")
def win_split(spark, sf, share=0.7):
    d = table(spark, sf, "documents").select("doc_id")
    cut = quantiles(d, "doc_id", [share], disc=True).select(F.col("q")[0].alias("c"))  # one row
    return d.join(F.broadcast(cut)).select("doc_id", F.when(F.col("doc_id") <= F.col("c"), "train").otherwise("validation").alias("side"))


@query("rank_models", "SELECT brand, model, metric FROM (SELECT p_brand AS brand, p_partkey AS model, p_retailprice AS metric, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_retailprice > 0.01) WHERE r = 1")
def rank_models(spark, sf):
    p = table(spark, sf, "part").filter("p_retailprice > 0.01")
    best = p.groupBy(F.col("p_brand").alias("brand")).agg(F.max(F.struct(F.col("p_retailprice").alias("metric"), (-F.col("p_partkey")).alias("neg"))).alias("m"))
    return best.select("brand", (-F.col("m.neg")).alias("model"), F.col("m.metric").alias("metric"))


@query("rank_runs", "WITH r AS (SELECT p_type, p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50.0::DOUBLE END AS stored, p_size / 60.0::DOUBLE AS sem, (p_retailprice % 100) / 100 AS gro FROM part), c AS (SELECT *, coalesce(stored, 0.5 * sem + 0.5 * gro) AS composite FROM r) SELECT p_type, p_partkey AS run, round(composite, 6) AS composite FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY stored DESC NULLS LAST, composite DESC, p_partkey) AS k FROM c) WHERE k = 1")
def rank_runs(spark, sf):
    """Runs by their stored composite; those without one come last, by the computed one."""
    p = table(spark, sf, "part")
    stored = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 50)
    composite = F.coalesce(stored, 0.5 * F.col("p_size") / 60 + 0.5 * (F.col("p_retailprice") % 100) / 100)
    best = p.groupBy("p_type").agg(F.max(F.struct(stored.isNotNull().alias("has"), stored.alias("stored"), composite.alias("composite"), (-F.col("p_partkey")).alias("neg"))).alias("m"))
    return best.select("p_type", (-F.col("m.neg")).alias("run"), r6(F.col("m.composite")).alias("composite"))


#: Lines of orders that a task groups, about.
TASK_LINES = 500_000


@query("prj_epoch_flat", "SELECT l_orderkey, " + ", ".join(f"coalesce(round(sum(CASE WHEN l_linenumber = {i} THEN l_quantity END), 6), 0) AS class_{i}" for i in range(1, 8)) + ", count(*) AS n FROM lineitem GROUP BY 1")
def prj_epoch_flat(spark, sf):
    # an order has a few lines, so that groups of a whole file's part would fill a task's memory; tasks grow in number instead.
    # One sum a class, as a pivot groups twice and keeps an array for each of its aggregates
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_LINES))
    per = [F.sum(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"q{i}") for i in range(1, 8)]
    g = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(*per, F.count("*").alias("n"))
    return g.select("l_orderkey", *[F.coalesce(r6(F.col(f"q{i}")), F.lit(0.0)).alias(f"class_{i}") for i in range(1, 8)], "n")


@query("agg_model_compare", "SELECT p_partkey AS model, metric, coalesce(value, 0) AS value FROM (SELECT p_partkey, unnest(['size', 'price', 'missing']) AS metric, unnest([p_size::DOUBLE, p_retailprice, CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE END]) AS value FROM part)")
def agg_model_compare(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("model"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 2 == 0, F.lit(1.0)).alias("missing"))
    return p.unpivot("model", ["size", "price", "missing"], "metric", "value").withColumn("value", F.coalesce("value", F.lit(0.0)))


