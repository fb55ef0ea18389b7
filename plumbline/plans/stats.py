"""Queries of drift, tests, fairness and mitigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as ST
from ..operators.profile import r6
from ..operators.thresholds import optimal_thresholds
from .base import events, query, table
from .text import pairs, topics_sql


def _ks_sql(src, v, new):
    return f"(SELECT max(abs(fb / nb - fw / nw)) AS d, max(nb) AS n, max(nw) AS m FROM (SELECT v, sum(sum(b)) OVER (ORDER BY v) AS fb, sum(sum(w)) OVER (ORDER BY v) AS fw, sum(sum(b)) OVER () AS nb, sum(sum(w)) OVER () AS nw FROM (SELECT {v} AS v, CASE WHEN {new} THEN 0 ELSE 1 END AS b, CASE WHEN {new} THEN 1 ELSE 0 END AS w FROM {src} WHERE {v} IS NOT NULL) GROUP BY v))"


#: Shares of lattice paths that have left the band, diagonal after diagonal; each point adds to the two next ones.
_KS_EXACT = """(WITH RECURSIVE path(s, i, v) AS (
        SELECT 0::BIGINT, 0::BIGINT, 0.0::DOUBLE WHERE greatest(n, m) <= 10000
        UNION ALL
        SELECT s, i, CASE WHEN abs(i * (m::BIGINT // gcd(n::BIGINT, m::BIGINT)) - (s - i) * (n::BIGINT // gcd(n::BIGINT, m::BIGINT))) >= round(d * (n::BIGINT // gcd(n::BIGINT, m::BIGINT)) * m) THEN 1.0::DOUBLE ELSE v END
        FROM (SELECT s + 1 AS s, i + k AS i, sum(v * CASE WHEN k = 1 THEN i + 1 ELSE s + 1 - i END / (s + 1)) AS v
              FROM path, (VALUES (0), (1)) AS t(k) WHERE s < n + m AND i + k <= n AND s + 1 - i - k <= m GROUP BY s + 1, i + k))
    SELECT least(1.0, max(v)) FROM path WHERE s = n + m)"""
_X = "(d * sqrt(n * m / (n + m)))"
#: The tail of d over n and m values: exact for small samples, else the limit's, by the series that converges where it is used.
_KS_P = f"""CASE WHEN d <= 0 THEN 1.0 WHEN greatest(n, m) <= 10000 THEN {_KS_EXACT}
    WHEN {_X} < 1.18 THEN greatest(0.0, 1 - sqrt(2 * pi()) / {_X} * list_sum(list_transform(range(1, 8), lambda j: exp(-(2 * j - 1) * (2 * j - 1) * pi() * pi() / (8 * {_X} * {_X})))))
    ELSE least(1.0, 2 * list_sum(list_transform(range(1, 8), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * {_X} * {_X})))) END"""


def _chi_p(x, k):
    """The tail of a chi-square of k degrees: one less the sum of its series, of as many terms as matter."""
    z, a = f"({x} / 2)", f"({k} / 2)"
    # beyond 700 + 10 a the tail is under exp(-700); a list is made for no such row
    terms = f"range(0, CAST(ceil(greatest(least({z}, 700 + 10 * {a}) - {a}, 0) + 12 * sqrt(least({z}, 700 + 10 * {a})) + 200) AS BIGINT))"
    series = f"list_sum(list_transform({terms}, lambda j: exp(({a} + j) * ln({z}) - {z} - lgamma({a} + j + 1))))"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 OR {k} < 1 THEN 1.0 WHEN {z} > 700 + 10 * {a} THEN 0.0 ELSE greatest(0.0, 1 - {series}) END"


def _drift_sql(src, v, new, extra=""):
    lead = f"{extra}, " if extra else ""
    one = f"SELECT {lead}round(abs(mn - mb) / (sb + 1e-7), 6) AS mean_shift, round(sn / sb, 6) AS std_ratio, round(100 * (mn - mb) / mb, 6) AS mean_change_pct, round(d, 6) AS ks, {_KS_P} AS raw_p, n::BIGINT AS n_base, m::BIGINT AS n_new FROM (SELECT avg({v}) FILTER (NOT ({new})) AS mb, avg({v}) FILTER ({new}) AS mn, stddev_samp({v}) FILTER (NOT ({new})) AS sb, stddev_samp({v}) FILTER ({new}) AS sn FROM {src}), {_ks_sql(src, v, new)}"
    return f"SELECT * EXCLUDE (raw_p), round(raw_p, 6) AS p, mean_shift > 0.1 OR abs(std_ratio - 1) > 0.1 OR raw_p < 0.05 AS drift FROM ({one})"


def halves(df, key):
    return df.filter(F.col(key) % 2 == 0), df.filter(F.col(key) % 2 == 1)


@query("stat_numeric_drift", _drift_sql("lineitem", "l_extendedprice", "l_shipdate >= TIMESTAMP '1998-01-01'"))
def stat_numeric_drift(spark, sf):
    return ST.numeric_drift(table(spark, sf, "lineitem").select("l_extendedprice", "l_shipdate"), "l_extendedprice", F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))


@query("stat_ks", f"SELECT round(d, 6) AS d, n::BIGINT AS n, m::BIGINT AS m, round({_KS_P}, 6) AS p FROM {_ks_sql('lineitem', 'l_extendedprice', 'l_orderkey % 2 = 1')}")
def stat_ks(spark, sf):
    one = ST.with_p(ST.ks(table(spark, sf, "lineitem").select("l_extendedprice", "l_orderkey"), "l_extendedprice", F.col("l_orderkey") % 2 == 1), "ks")
    return one.select(r6(F.col("d")).alias("d"), "n", "m", r6(F.col("p")).alias("p"))


def _chi_sql(src, col, key, label=None, common=False):
    lead = f"'{label}' AS feature, " if label else ""
    tested = "both_ > 1" if common else "base_distinct > 1 AND new_distinct > 1"
    few = lambda name, where, shown, order, most: f"(SELECT coalesce(string_agg(i, ',' ORDER BY i), '') AS {name} FROM (SELECT {shown} AS i FROM c WHERE {where} ORDER BY {order} LIMIT {most}))"
    return f"""SELECT {lead}* EXCLUDE (both_, raw_p), round(raw_p, 6) AS p, CASE WHEN {tested} THEN raw_p < 0.05 ELSE new_categories > 0 OR missing_categories > 0 END AS drift FROM (
    WITH c AS (SELECT {col} AS v, count(CASE WHEN {key} % 2 = 0 THEN 1 END) AS b, count(CASE WHEN {key} % 2 = 1 THEN 1 END) AS w FROM {src} WHERE {col} IS NOT NULL GROUP BY 1),
    x AS (SELECT *, greatest(b / tb * greatest(tb, tw), 1e-10) AS e, greatest(w / tw * greatest(tb, tw), 1e-10) AS o FROM (SELECT *, sum(b) OVER () AS tb, sum(w) OVER () AS tw FROM c)),
    s AS (SELECT sum((o - e) * (o - e) / e) AS chi, CAST(count(*) - 1 AS INTEGER) AS dof, count(CASE WHEN b = 0 THEN 1 END) AS new_categories, count(CASE WHEN w = 0 THEN 1 END) AS missing_categories, count(CASE WHEN b > 0 THEN 1 END) AS base_distinct, count(CASE WHEN w > 0 THEN 1 END) AS new_distinct, count(CASE WHEN b > 0 AND w > 0 THEN 1 END) AS both_ FROM x),
    k AS (SELECT * EXCLUDE (chi), CASE WHEN {tested} THEN chi END AS stat FROM s)
    SELECT round(stat, 5) AS statistic, * EXCLUDE (stat), {_chi_p('stat', 'dof')} AS raw_p FROM k, {few('top_base', 'b > 0', "v || ':' || b", 'b DESC, v', 5)}, {few('top_new', 'w > 0', "v || ':' || w", 'w DESC, v', 5)}, {few('new_values', 'b = 0', 'v', 'v', 10)}, {few('missing_values', 'w = 0', 'v', 'v', 10)})"""


def _chi(df, col, key, common=False):
    return ST.chi2_drift(*halves(df, key), col, common=common).withColumn("statistic", F.round("statistic", 5))


@query("stat_chi2_gof", _chi_sql("orders", "o_orderpriority", "o_orderkey"))
def stat_chi2_gof(spark, sf):
    return _chi(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


_TOPIC_WORDS = ["the", "der", "para", "les", "und", "and"]
_TOPICS = f"(SELECT doc_id, unnest({topics_sql(_TOPIC_WORDS)}) AS topic FROM documents)"


def topics(spark, sf):
    # an outer explode, as for an inner one the texts are searched once more in a filter
    return table(spark, sf, "documents").select("doc_id", F.explode_outer(T.topics(F.col("text"), _TOPIC_WORDS)).alias("topic")).filter("topic is not null")


@query("stat_topics_drift", _chi_sql(_TOPICS, "topic", "doc_id", common=True))
def stat_topics_drift(spark, sf):
    return _chi(topics(spark, sf), "topic", "doc_id", common=True)


_PD = "(SELECT *, o_orderdate >= TIMESTAMP '1998-01-01' AS new FROM orders)"


_CATS = ["o_orderstatus", "o_orderpriority"]


def _cells_sql(c):
    return f"""SELECT '{c}' AS feature, 'chi2' AS test, CASE WHEN k < 2 THEN 'too_few_cells' WHEN least_e < 1 THEN 'skipped_unequal_totals' ELSE 'tested' END AS status, CASE WHEN k >= 2 AND least_e >= 1 THEN x END AS x, k - 1 AS dof
        FROM (SELECT count(*) AS k, min(e) AS least_e, sum((w - e) * (w - e) / e) AS x FROM (SELECT *, b / sum(b) OVER () * sum(w) OVER () AS e FROM (SELECT {c}, count(CASE WHEN NOT new THEN 1 END) AS b, count(CASE WHEN new THEN 1 END) AS w FROM {_PD} GROUP BY 1)))"""


@query("stat_partition_drift", f"""SELECT 'o_totalprice' AS feature, 'ks' AS test, round(d, 6) AS statistic, 'tested' AS status, round(p, 6) AS p, p < 1e-5 AS drift FROM (SELECT d, {_KS_P} AS p FROM {_ks_sql(_PD, 'o_totalprice', 'new')})
    UNION ALL SELECT feature, test, round(x, 5), status, round(p, 6), coalesce(p < 1e-5, false) FROM (SELECT *, {_chi_p('x', 'dof')} AS p FROM ({' UNION ALL '.join(map(_cells_sql, _CATS))}))""")
def stat_partition_drift(spark, sf, alpha=1e-5):
    o = table(spark, sf, "orders").withColumn("new", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    num = ST.with_p(ST.ks(o, "o_totalprice", F.col("new")), "ks").select(F.lit("o_totalprice").alias("feature"), F.lit("ks").alias("test"), r6(F.col("d")).alias("statistic"), F.lit("tested").alias("status"), "p")
    long = ST.slices(o, _CATS, ["new"]).filter("value is not null").groupBy("feature", "value").agg(F.count_if(~F.col("new")).alias("b"), F.count_if("new").alias("w"))
    t = long.groupBy("feature").agg(F.sum("b").alias("tb"), F.sum("w").alias("tw"))
    e = F.col("b") / F.col("tb") * F.col("tw")
    cat = long.join(F.broadcast(t), "feature").withColumn("e", e).groupBy("feature").agg(F.count("*").alias("k"), F.min("e").alias("least"), F.sum((F.col("w") - F.col("e")) * (F.col("w") - F.col("e")) / F.col("e")).alias("x"))
    status = F.when(F.col("k") < 2, "too_few_cells").when(F.col("least") < 1, "skipped_unequal_totals").otherwise("tested")
    cat = ST.with_p(cat.select("feature", F.when(status == "tested", F.col("x")).alias("statistic"), (F.col("k") - 1).cast("int").alias("dof"), status.alias("status")), "chi2")
    both = num.union(cat.select("feature", F.lit("chi2"), F.round("statistic", 5), "status", "p"))
    return both.withColumn("drift", F.coalesce(F.col("p") < alpha, F.lit(False))).withColumn("p", r6(F.col("p")))


@query("stat_detect_all", "SELECT feature, ks AS statistic, p, drift FROM (" + _drift_sql("documents", "n_chars", "doc_id % 2 = 1", "'n_chars' AS feature") + ")" + "".join(
    f" UNION ALL SELECT feature, statistic, p, drift FROM ({_chi_sql(src, c, 'doc_id', name, name == 'topics')})" for name, src, c in (("lang", "documents", "lang"), ("source", "documents", "source"), ("topics", _TOPICS, "topic"))))
def stat_detect_all(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    out = ST.numeric_drift(d, "n_chars", F.col("doc_id") % 2 == 1).select(F.lit("n_chars").alias("feature"), F.col("ks").alias("statistic"), "p", "drift")
    for name, df, col in (("lang", d, "lang"), ("source", d, "source"), ("topics", topics(spark, sf), "topic")):
        out = out.union(_chi(df, col, "doc_id", name == "topics").select(F.lit(name), "statistic", "p", "drift"))
    return out


_QL = "(SELECT conv_id, turn, length(text)::DOUBLE AS chars, len(regexp_extract_all(text, '\\S+'))::DOUBLE AS words FROM conversations WHERE role = 'user')"
#: Logs that a verdict needs.
LEAST_LOGS = 100


@query("stat_query_drift", f"SELECT * EXCLUDE (drift), n_new >= {LEAST_LOGS} AND drift AS drift, CASE WHEN n_new < {LEAST_LOGS} THEN 'insufficient_data' ELSE 'tested' END AS reason, n_new >= {LEAST_LOGS} AND bool_or(drift) OVER () AS has_drift FROM (" + " UNION ALL ".join(_drift_sql(_QL, v, "turn > 0", f"'{v}' AS feature") for v in ("chars", "words")) + ")")
def stat_query_drift(spark, sf):
    """Later turns' queries against first ones; no verdict on fewer than ``LEAST_LOGS``."""
    c = table(spark, sf, "conversations").filter("role = 'user'").select("turn", F.char_length("text").alias("chars"), F.regexp_count("text", F.lit(r"\S+")).alias("words"))
    one = [ST.numeric_drift(c, v, F.col("turn") > 0).select(F.lit(v).alias("feature"), "*") for v in ("chars", "words")]
    both, enough = one[0].union(one[1]), F.col("n_new") >= LEAST_LOGS
    any_ = both.agg(F.bool_or("drift").alias("any"))  # one row of two
    return both.join(F.broadcast(any_)).withColumn("has_drift", enough & F.col("any")).withColumn("drift", enough & F.col("drift")).withColumn("reason", F.when(enough, "tested").otherwise("insufficient_data")).drop("any")


@query("stat_chi2_indep", f"SELECT round(x, 5) AS statistic, dof, round({_chi_p('x', 'dof')}, 6) AS p, {_chi_p('x', 'dof')} > 0.05 AS independent FROM (WITH c AS (SELECT event_type AS a, user_id % 3 AS b, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM c) SELECT sum((n - ra * rb / t) * (n - ra * rb / t) / (ra * rb / t)) AS x, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS INTEGER) AS dof FROM m)")
def stat_chi2_indep(spark, sf):
    e = events(spark, sf).withColumn("b", F.col("user_id") % 3)
    return ST.chi2_independence(e, "event_type", "b").withColumn("statistic", F.round("statistic", 5))


@query("stat_uniform_parity", "SELECT count(*) AS groups, round(max(abs(n - m)) / max(m), 6) AS deviation, max(abs(n - m)) / max(m) < 0.3 AS fair FROM (SELECT count(*) AS n, avg(count(*)) OVER () AS m FROM orders GROUP BY o_orderstatus)")
def stat_uniform_parity(spark, sf):
    return ST.group_shares(table(spark, sf, "orders"), "o_orderstatus").agg(F.count("*").alias("groups"), F.max("deviation").alias("deviation"), F.bool_and("fair").alias("fair"))


@query("stat_cohens_d", "SELECT count(a) AS na, count(b) AS nb, round(abs(avg(a) - avg(b)) / sqrt(((count(a) - 1) * var_samp(a) + (count(b) - 1) * var_samp(b)) / (count(a) + count(b) - 2)), 6) AS d FROM (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS a, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS b FROM customer)")
def stat_cohens_d(spark, sf):
    return ST.cohens_d(table(spark, sf, "customer"), "c_acctbal", F.col("c_mktsegment") == "BUILDING")


@query("stat_disparate_impact", "SELECT o_orderpriority AS grp, count(*) AS n, round(count(*) / max(count(*)) OVER (), 6) AS impact, count(*) / max(count(*)) OVER () < 0.8 AS disparate FROM orders GROUP BY 1")
def stat_disparate_impact(spark, sf):
    return ST.group_shares(table(spark, sf, "orders"), "o_orderpriority").select("grp", "n", "impact", "disparate")


_SLICE = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::VARCHAR AS value, c_acctbal, band FROM c" for f in ("c_mktsegment", "c_nationkey"))


@query("stat_slice_finder", f"""WITH c AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'top' END AS band FROM customer), l AS ({_SLICE}), t AS (SELECT count(*) AS nn, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM c),
    k AS (SELECT feature, count(DISTINCT value) AS k FROM l GROUP BY 1), a AS (SELECT feature, value, count(*) AS n, avg(c_acctbal) AS m FROM l GROUP BY ALL),
    sc AS (SELECT a.feature, a.value, 0.5 * sum(abs(coalesce(x.n, 0) / a.n - o.n / nn)) AS score FROM a CROSS JOIN (SELECT band, count(*) AS n FROM c GROUP BY 1) o CROSS JOIN t LEFT JOIN (SELECT feature, value, band, count(*) AS n FROM l GROUP BY ALL) x ON x.feature = a.feature AND x.value = a.value AND x.band = o.band GROUP BY ALL),
    r AS (SELECT a.feature, a.value, a.n, a.n / nn AS share, (abs(a.n / nn - 1 / k) > 0.1)::INT + (abs(a.m - t.m) / s > 2)::INT AS issues, score FROM a JOIN k USING (feature) JOIN sc USING (feature, value), t WHERE a.n >= 30)
    SELECT feature, value, n, round(share, 6) AS share, issues, round(score, 6) AS score, CASE WHEN issues > 2 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE issues > 0 ORDER BY issues DESC, feature, value LIMIT 10""")
def stat_slice_finder(spark, sf):
    c = table(spark, sf, "customer").withColumn("band", F.when(F.col("c_acctbal") < 0, "neg").when(F.col("c_acctbal") < 5000, "mid").otherwise("top"))
    return ST.slice_finder(c, ["c_mktsegment", "c_nationkey"], ["c_acctbal"], "band")


def labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")


_LAB = "lab AS (SELECT * FROM documents JOIN labels USING (doc_id))"
_LONG = "long AS (SELECT 'lang' AS feature, lang AS value, * FROM lab UNION ALL SELECT 'source', source, * FROM lab)"


@query("stat_positive_rate_slices", f"WITH {_LAB}, {_LONG}, s AS (SELECT feature, value, count(*) AS n, avg(toxic) AS rate FROM long GROUP BY ALL), o AS (SELECT avg(toxic) AS a FROM lab) SELECT feature, value, n, round(rate, 6) AS rate, round(abs(rate - a) / a, 6) AS deviation, CASE WHEN abs(rate - a) / a > 0.5 THEN 'high' ELSE 'medium' END AS severity FROM s, o WHERE n >= 10 AND abs(rate - a) / a > 0.2")
def stat_positive_rate_slices(spark, sf):
    return ST.positive_rate_slices(labelled(spark, sf), ["lang", "source"], F.col("toxic") == 1, least=10)


def _frame_sql(src, group):
    cells = "count(*) AS n, count(CASE WHEN y AND p THEN 1 END) AS tp, count(CASE WHEN NOT y AND p THEN 1 END) AS fp, count(CASE WHEN y AND NOT p THEN 1 END) AS fn, count(CASE WHEN NOT y AND NOT p THEN 1 END) AS tn"
    return f"(SELECT {group}, n, " + ", ".join(f"CASE WHEN {b} = 0 THEN 0 ELSE round(({a}) / ({b}), 6) END AS {k}" for k, (a, b) in ST.RATES.items()) + f" FROM (SELECT {group}, {cells} FROM {src} GROUP BY ALL))"


_YP = "yp AS (SELECT *, quality = 1 AS y, n_chars > 1500 AS p FROM lab)"


def frame(spark, sf):
    return ST.metric_frame(labelled(spark, sf), ["lang"], F.col("quality") == 1, F.col("n_chars") > 1500)


@query("stat_metric_frame", f"WITH {_LAB}, {_YP}, f AS (SELECT * FROM {_frame_sql('yp', 'lang')}) SELECT * FROM f UNION ALL SELECT 'overall', * EXCLUDE (u) FROM {_frame_sql('(SELECT 1 AS u, * FROM yp)', 'u')} UNION ALL SELECT 'difference', sum(n)::BIGINT, " + ", ".join(f"round(max({c}) - min({c}), 6)" for c in ST.RATES) + " FROM f")
def stat_metric_frame(spark, sf):
    rows = labelled(spark, sf)
    overall = ST.metric_frame(rows, [], F.col("quality") == 1, F.col("n_chars") > 1500)
    return ST.with_summary(frame(spark, sf), overall, "lang")


_FAIR = "round(max(selection_rate) - min(selection_rate), 6) AS dp_difference, round(coalesce(min(selection_rate) / nullif(max(selection_rate), 0), 0), 6) AS dp_ratio, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS eo_difference, round(least(coalesce(min(tpr) / nullif(max(tpr), 0), 0), coalesce(min(fpr) / nullif(max(fpr), 0), 0)), 6) AS eo_ratio, round(max(accuracy) - min(accuracy), 6) AS accuracy_gap"


@query("stat_fairness", f"WITH {_LAB}, {_YP}, f AS (SELECT {_FAIR} FROM {_frame_sql('yp', 'lang')}) SELECT *, dp_difference > 0.1 AS dp_flag, eo_difference > 0.1 AS eo_flag, accuracy_gap > 0.1 AS accuracy_flag FROM f")
def stat_fairness(spark, sf):
    return ST.fairness(frame(spark, sf))


def _weighted_sql(src, group):
    part = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b}) END"
    both = lambda a, b: f"round(((tp + fn) * ({a}) + (tn + fp) * ({b})) / n, 6)"
    cells = "count(*) AS n, count(CASE WHEN y AND p THEN 1 END) AS tp, count(CASE WHEN NOT y AND p THEN 1 END) AS fp, count(CASE WHEN y AND NOT p THEN 1 END) AS fn, count(CASE WHEN NOT y AND NOT p THEN 1 END) AS tn"
    return f"(SELECT {group}, n, round((tp + tn) / n, 6) AS accuracy, round((tp + fp) / n, 6) AS selection_rate, {both(part('tp', '(tp + fp)'), part('tn', '(tn + fn)'))} AS precision, {both(part('tp', '(tp + fn)'), part('tn', '(tn + fp)'))} AS recall, {both(part('2 * tp', '(2 * tp + fp + fn)'), part('2 * tn', '(2 * tn + fp + fn)'))} AS f1 FROM (SELECT {group}, {cells} FROM {src} GROUP BY ALL))"


@query("stat_manual_fairness", f"WITH {_LAB}, {_YP}, w AS (SELECT * FROM {_weighted_sql('yp', 'lang AS grp').replace('(SELECT lang AS grp, n,', '(SELECT grp, n,', 1)} WHERE n >= 20) SELECT *, round(max(selection_rate) OVER () - min(selection_rate) OVER (), 6) AS parity_gap, round(max(accuracy) OVER () - min(accuracy) OVER (), 6) AS accuracy_gap FROM w")
def stat_manual_fairness(spark, sf, least=20):
    f = ST.weighted_frame(labelled(spark, sf).withColumnRenamed("lang", "grp"), ["grp"], F.col("quality") == 1, F.col("n_chars") > 1500).filter(F.col("n") >= least)
    gap = f.agg(r6(F.max("selection_rate") - F.min("selection_rate")).alias("parity_gap"), r6(F.max("accuracy") - F.min("accuracy")).alias("accuracy_gap"))  # one row
    return f.join(F.broadcast(gap))


def slice_performance(predicted, features, label, prediction, least=10, gap=0.2):
    """Accuracy and weighted precision, recall and F1 of each slice of ``least``
    rows or more; a feature is biased if its accuracies differ by over ``gap``."""
    per = ST.weighted_frame(ST.slices(predicted, features, [label, prediction]), ["feature", "value"], F.col(label) == 1, F.col(prediction) == 1).filter(F.col("n") >= least).drop("selection_rate")
    span = per.groupBy("feature").agg((F.max("accuracy") - F.min("accuracy") > gap).alias("biased"))
    return per.join(span, "feature")


@query("stat_slice_performance")
def stat_slice_performance(spark, sf):
    """A random forest of 100 trees on encoded slice features, judged by slice on a fifth of the rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    d = labelled(spark, sf).withColumn("label", F.col("toxic").cast("double")).fillna("", ["lang", "source"])
    stages = [StringIndexer(inputCols=["lang", "source"], outputCols=["li", "si"], handleInvalid="keep"), VectorAssembler(inputCols=["li", "si", "n_chars"], outputCol="features"), RandomForestClassifier(numTrees=100, maxBins=64, seed=42)]
    test = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = Pipeline(stages=stages).fit(d.filter(~test))
    return slice_performance(model.transform(d.filter(test)), ["lang", "source"], "label", "prediction")


_RAG = "rag AS (SELECT conv_id, turn, CASE WHEN length(question) > 200 THEN 'long' ELSE 'short' END AS size, (conv_id % 4)::VARCHAR AS bucket, length(answer) > 400 AS y, length(question) > 150 AS p FROM pair)"
_RAGL = "rl AS (SELECT 'size' AS feature, size AS value, y, p FROM rag UNION ALL SELECT 'bucket', bucket, y, p FROM rag)"


def rag_slices(spark, sf):
    p = pairs(spark, sf).select(F.when(F.char_length("question") > 200, "long").otherwise("short").alias("size"), (F.col("conv_id") % 4).cast("string").alias("bucket"), (F.char_length("answer") > 400).alias("y"), (F.char_length("question") > 150).alias("p"))
    return ST.metric_frame(ST.slices(p, ["size", "bucket"], ["y", "p"]), ["feature", "value"], F.col("y"), F.col("p"))


from .text import PAIRS_SQL  # noqa: E402

_RAGF = f"WITH {PAIRS_SQL}, {_RAG}, {_RAGL}, f AS (SELECT * FROM {_frame_sql('rl', 'feature, value')})"


@query("stat_rag_slices", _RAGF + " SELECT * FROM f")
def stat_rag_slices(spark, sf):
    return rag_slices(spark, sf)


def _over_sql(t):
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c}_range > {t} THEN '{c}' END" for c in ("accuracy", "f1", "fpr", "fnr")) + ")"


@query("stat_disparities", _RAGF + ", g AS (SELECT feature, count(*) AS slices, " + ", ".join(f"round(max({c}) - min({c}), 6) AS {c}_range" for c in ("accuracy", "f1", "fpr", "fnr")) + ", round(stddev_pop(accuracy), 6) AS accuracy_std, round(stddev_pop(f1), 6) AS f1_std, arg_min(value, (accuracy, value)) AS worst, arg_min(value, (-accuracy, value)) AS best FROM f GROUP BY 1 HAVING count(*) >= 2) SELECT *, " + _over_sql(0.05) + " AS violations, " + _over_sql(0.1) + " AS wide_violations FROM g")
def stat_disparities(spark, sf):
    return ST.disparities(rag_slices(spark, sf))


_SEV = "CASE WHEN {} > 0.3 THEN 'high' ELSE 'medium' END"


@query("stat_bias_findings", f"WITH {_LAB}, {_YP}, {_LONG}, f AS (SELECT {_FAIR} FROM {_frame_sql('yp', 'lang')}), s AS (SELECT feature, value, count(*) AS n, avg(toxic) AS rate FROM long GROUP BY ALL), o AS (SELECT avg(toxic) AS a FROM lab) " + " UNION ".join([
    *[f"SELECT '{k}' AS kind, 'lang' AS feature, {_SEV.format(c)} AS severity FROM f WHERE {c} > 0.1" for k, c in (("parity", "dp_difference"), ("odds", "eo_difference"), ("performance", "accuracy_gap"))],
    "SELECT 'share', 'lang', 'medium' FROM (SELECT lang, count(*) AS n, max(count(*)) OVER () AS m FROM lab GROUP BY 1) WHERE n / m < 0.8",
    "SELECT 'slice', feature, CASE WHEN abs(rate - a) / a > 0.5 THEN 'high' ELSE 'medium' END FROM s, o WHERE n >= 10 AND abs(rate - a) / a > 0.2"]))
def stat_bias_findings(spark, sf):
    """Findings of each kind with severity; the distinct features are what to stratify by."""
    rows = labelled(spark, sf)
    f = ST.fairness(frame(spark, sf))
    sev = lambda c: F.when(F.col(c) > 0.3, "high").otherwise("medium")
    kinds = (("parity", "dp_flag", "dp_difference"), ("odds", "eo_flag", "eo_difference"), ("performance", "accuracy_flag", "accuracy_gap"))
    one = F.array_compact(F.array(*[F.when(F.col(flag), F.struct(F.lit(k).alias("kind"), F.lit("lang").alias("feature"), sev(c).alias("severity"))) for k, flag, c in kinds]))
    out = f.select(F.explode(one).alias("r")).select("r.*")
    out = out.union(ST.group_shares(rows, "lang").filter("disparate").select(F.lit("share"), F.lit("lang"), F.lit("medium")))
    return out.union(ST.positive_rate_slices(rows, ["lang", "source"], F.col("toxic") == 1, least=10).select(F.lit("slice"), "feature", "severity")).distinct()


@query("stat_2sigma_share", "WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem) SELECT count(*) AS n, count(CASE WHEN abs(l_extendedprice - m) > 2 * d THEN 1 END) AS beyond, round(100.0 * count(CASE WHEN abs(l_extendedprice - m) > 2 * d THEN 1 END) / count(*), 6) AS percent, 100.0 * count(CASE WHEN abs(l_extendedprice - m) > 2 * d THEN 1 END) / count(*) > 5 AS warn FROM lineitem, s")
def stat_2sigma_share(spark, sf):
    li = table(spark, sf, "lineitem").select("l_extendedprice")
    s = li.agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("d"))  # one row
    out = li.join(F.broadcast(s)).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("l_extendedprice") - F.col("m")) > 2 * F.col("d")).alias("beyond"))
    return out.select("n", "beyond", r6(100 * F.col("beyond") / F.col("n")).alias("percent"), (100 * F.col("beyond") / F.col("n") > 5).alias("warn"))


_RES = "res AS (SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR || '42')) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS c FROM orders), (SELECT floor(floor(count(*) / count(DISTINCT o_orderstatus)) * 0.8)::BIGINT AS t FROM orders), LATERAL (SELECT unnest(range(0, floor((t - r) / c)::BIGINT + 1)) AS copy) WHERE r <= t)"


@query("mit_resample", f"WITH {_RES} SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS distinct_rows, sum(o_orderkey)::BIGINT AS key_sum FROM res GROUP BY 1")
def mit_resample(spark, sf):
    r = ST.resample(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")
    return r.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_rows"), F.sum("o_orderkey").alias("key_sum"))


@query("mit_weights", "WITH w AS (SELECT c_custkey, n / (ka * ca) * n / (kb * cb) AS w FROM (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY c_mktsegment) AS ca, count(*) OVER (PARTITION BY c_nationkey) AS cb FROM customer), (SELECT count(DISTINCT c_mktsegment) AS ka, count(DISTINCT c_nationkey) AS kb FROM customer)) SELECT c_custkey, round(w / avg(w) OVER (), 6) AS weight FROM w")
def mit_weights(spark, sf):
    return ST.weights(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"]).select("c_custkey", "weight")


@query("mit_effect", f"WITH {_RES}, a AS (SELECT count(*) AS k FROM (SELECT count(*) AS n, max(count(*)) OVER () AS m FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 4 = 0) GROUP BY o_orderstatus) WHERE n / m < 0.8), b AS (SELECT count(*) AS k FROM (SELECT count(*) AS n, max(count(*)) OVER () AS m FROM res GROUP BY o_orderstatus) WHERE n / m < 0.8) SELECT a.k AS before, b.k AS after, a.k - b.k AS reduction, round(CASE WHEN a.k = 0 THEN 0 ELSE 100.0 * (a.k - b.k) / a.k END, 6) AS percent FROM a, b")
def mit_effect(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    found = lambda df: ST.group_shares(df, "o_orderstatus").agg(F.count_if("disparate").alias("k"))
    a = found(o.filter("o_orderstatus <> 'P' or o_orderkey % 4 = 0")).select(F.col("k").alias("before"))
    b = found(ST.resample(o, "o_orderstatus", "o_orderkey")).select(F.col("k").alias("after"))
    diff = F.col("before") - F.col("after")
    return a.join(F.broadcast(b)).select("before", "after", diff.alias("reduction"), r6(F.coalesce(F.try_divide(100 * diff, "before"), F.lit(0.0))).alias("percent"))  # one row each


_CUTS = f"""{_LAB}, r AS (SELECT lang AS grp, CAST(least(floor(least(n_chars, 5000) / 5000 * 20), 19) AS INTEGER) AS bin, quality AS y FROM lab),
    s AS (SELECT grp, t, count(*) AS n, sum(y) AS pos, count(CASE WHEN bin >= t THEN 1 END) AS called, coalesce(sum(CASE WHEN bin >= t THEN y END), 0) AS tp FROM r, (SELECT unnest(range(21))::INTEGER AS t) GROUP BY ALL),
    v AS (SELECT *, pos > 0 AND pos < n AS ok, round((tp + (n - called) - (pos - tp)) / n, 9) AS acc FROM s)"""
#: A group with one label has only the middle of the grid.
_CUT = "k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN gap <= 0.1 THEN 0 ELSE 1 END, CASE WHEN gap <= 0.1 THEN -acc ELSE gap END, t) AS i FROM m WHERE ok OR t = 10) SELECT grp, n, round(t / 20, 6) AS threshold, round(acc, 6) AS accuracy, round(gap, 6) AS gap FROM k WHERE i = 1"


def _thresholds(spark, sf, constraint):
    d = labelled(spark, sf).withColumn("score", F.least("n_chars", F.lit(5000)) / 5000)
    return ST.group_thresholds(d, "lang", "score", F.col("quality") == 1, constraint=constraint)


@query("mit_thresholds", f"WITH {_CUTS}, m AS (SELECT *, round(abs(called / n - (SELECT sum(y) / count(*) FROM r)), 9) AS gap FROM v), {_CUT}")
def mit_thresholds(spark, sf):
    return _thresholds(spark, sf, "parity")


@query("mit_thresholds_odds", f"""WITH {_CUTS}, o AS (SELECT t, sum(tp) / sum(pos) AS tpr, (sum(called) - sum(tp)) / (sum(n) - sum(pos)) AS fpr, round((sum(tp) + (sum(n) - sum(called)) - (sum(pos) - sum(tp))) / sum(n), 9) AS a FROM v WHERE ok GROUP BY t),
    aim AS (SELECT tpr, fpr FROM o ORDER BY a DESC, t LIMIT 1),
    m AS (SELECT *, CASE WHEN ok THEN round(greatest(abs(tp / pos - (SELECT tpr FROM aim)), abs((called - tp) / (n - pos) - (SELECT fpr FROM aim))), 9) END AS gap FROM v), {_CUT}""")
def mit_thresholds_odds(spark, sf):
    return _thresholds(spark, sf, "odds")


# The curves' upper hulls by all pairs of points, their best common point by all places where a hull bends or two cross.
_HULL = f"""WITH {_LAB}, r AS (SELECT lang AS grp, least(n_chars, 5000) / 5000 AS s, quality AS y FROM lab WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
    g AS (SELECT grp, count(*) AS n, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM r GROUP BY grp),
    p AS (SELECT grp, sum(sum(y)) OVER w AS tp, sum(sum(1 - y)) OVER w AS fp FROM r GROUP BY grp, s WINDOW w AS (PARTITION BY grp ORDER BY s DESC) UNION ALL SELECT grp, 0, 0 FROM g),
    q AS (SELECT 'odds' AS kind, grp, n, pos, neg, fp / neg AS x, tp / pos AS y FROM p JOIN g USING (grp) WHERE pos > 0 AND neg > 0 UNION ALL SELECT 'parity', grp, n, pos, neg, (fp + tp) / n, tp / n FROM p JOIN g USING (grp)),
    xs AS (SELECT DISTINCT kind, x FROM q),
    h AS (SELECT kind, grp, n, pos, neg, xs.x, max(CASE WHEN b.x = a.x THEN greatest(a.y, b.y) ELSE a.y + (b.y - a.y) * (xs.x - a.x) / (b.x - a.x) END) AS y FROM xs JOIN q a USING (kind) JOIN q b USING (kind, grp, n, pos, neg) WHERE a.x <= xs.x AND b.x >= xs.x GROUP BY ALL),
    steps AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM h WHERE kind = 'odds' WINDOW w AS (PARTITION BY grp ORDER BY x)),
    crossings AS (SELECT DISTINCT i.x AS a, i.nx AS b, i.x + (i.nx - i.x) * (j.y - i.y) / ((i.ny - i.y) - (j.ny - j.y)) AS x FROM steps i JOIN steps j ON i.x = j.x AND i.grp < j.grp WHERE (i.y - j.y) * (i.ny - j.ny) < 0),
    every AS (SELECT kind, grp, n, pos, neg, x, y FROM h UNION ALL SELECT 'odds', grp, n, pos, neg, c.x, y + (ny - y) * (c.x - a) / (b - a) FROM crossings c JOIN steps s ON s.x = c.a),
    scored AS (SELECT kind, x, CASE WHEN kind = 'odds' THEN (sum(pos) * min(y) + sum(neg) * (1 - x)) / sum(n) ELSE sum(n * (2 * y - x) + neg) / sum(n) END AS right_ FROM every GROUP BY kind, x),
    best AS (SELECT kind, max(right_) AS overall FROM scored GROUP BY kind)
    SELECT kind, grp, n, round(overall, 6) AS overall, 0.0::DOUBLE AS gap FROM (SELECT DISTINCT kind, grp, n FROM q) JOIN best USING (kind)"""


@query("mit_thresholds_optimal", _HULL)
def mit_thresholds_optimal(spark, sf):
    """The best accuracy under parity and under odds, with the largest gap of the constrained rates."""
    d = labelled(spark, sf).withColumn("score", F.least("n_chars", F.lit(5000)) / 5000)
    out = None
    for kind, rates in (("odds", ["tpr", "fpr"]), ("parity", ["selection"])):
        t = optimal_thresholds(d, "lang", "score", F.col("quality") == 1, kind)
        ends = t.agg(F.greatest(*[F.max(c) - F.min(c) for c in rates], F.lit(0.0)).alias("gap"))  # one row
        one = t.join(F.broadcast(ends)).select(F.lit(kind).alias("kind"), "grp", "n", r6(F.col("overall")).alias("overall"), F.round("gap", 9).alias("gap"))
        out = one if out is None else out.union(one)
    return out
