"""Profiles of tables: one aggregate for all numeric columns, one melted
group-by for all text columns, whatever their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def melt(df: DataFrame, columns: list[str], kind: str = "string") -> DataFrame:
    """Rows (column, value) of some columns, nulls included."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def stacked(one: DataFrame, rows: list[tuple[str, list[Column]]], names: list[str]) -> DataFrame:
    """A one-row frame as a row per entry: a label and its values."""
    structs = [F.struct(F.lit(label).alias("column"), *[v.alias(n) for v, n in zip(values, names)]) for label, values in rows]
    return one.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, max and nulls of each numeric column."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in _STATS.items()])
    return stacked(one, [(c, [F.col(f"{n}_{c}") for n in _STATS]) for c in columns], list(_STATS))


_STATS = {
    "n": lambda c: F.count(c), "mean": lambda c: r6(F.avg(c)), "std": lambda c: r6(F.stddev_samp(c)), "min": lambda c: r6(F.min(c)), "max": lambda c: r6(F.max(c)),
    "missing": lambda c: F.count_if(F.col(c).isNull()),
}


def value_counts(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """Counts of non-null values by column; the ``top`` most frequent, ties by value."""
    counts = melt(df, columns).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    if top is None:
        return counts
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def text_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, distinct and missing of each text column, by one melted pass."""
    counts = melt(df, columns).groupBy("column", "value").agg(F.count("*").alias("k"))
    return counts.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("k")).otherwise(0)).alias("n"), F.count("value").alias("distinct"), F.sum(F.when(F.col("value").isNull(), F.col("k")).otherwise(0)).alias("missing")
    )


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean, median, std, quartiles, bias-corrected skewness and excess kurtosis."""
    aggs = []
    for c in columns:
        aggs += [
            F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"),
            F.skewness(c).alias(f"g1_{c}"), F.kurtosis(c).alias(f"g2_{c}"),
        ]
    rows = []
    for c in columns:
        n = F.col(f"n_{c}").cast("double")
        skew = F.when(n > 2, F.col(f"g1_{c}") * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col(f"g2_{c}") + 6))
        rows.append((c, [r6(F.col(f"mean_{c}")), r6(F.col(f"std_{c}")), F.round(skew, 5), F.round(kurt, 5)]))
    one = stacked(df.agg(*aggs), rows, ["mean", "std", "skewness", "kurtosis"])
    # one pass for the quantiles of all columns
    q = quantiles(melt(df, columns, "double"), "value", [0.0, 0.25, 0.5, 0.75, 1.0], by=["column"])
    at = lambda i: r6(F.col("q")[i])
    return one.join(F.broadcast(q), "column", "left").select("column", "mean", at(2).alias("median"), "std", at(0).alias("min"), at(4).alias("max"), at(1).alias("q25"), at(3).alias("q75"), "skewness", "kurtosis")


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bounds q1 - 1.5 iqr and q3 + 1.5 iqr, and what lies strictly beyond."""
    counts = prefix_counts(melt(df, columns, "double"), "value", {"k": F.count("*")}, ["column"])
    q = at_shares(counts, [0.25, 0.75], ["column"])  # a row a column
    iqr = F.col("q")[1] - F.col("q")[0]
    ends = q.select("column", (F.col("q")[0] - 1.5 * iqr).alias("lo"), (F.col("q")[1] + 1.5 * iqr).alias("hi"))
    beyond = F.sum(F.when((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")), F.col("k")).otherwise(0))
    one = counts.join(F.broadcast(ends), "column").groupBy("column").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), beyond.alias("outliers"), F.sum("k").alias("n"))
    return one.select("column", r6(F.col("lo")).alias("lower"), r6(F.col("hi")).alias("upper"), "outliers", r6(100 * F.col("outliers") / F.col("n")).alias("percent"))


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """distinct count, mode (ties: smallest) and Shannon entropy in bits."""
    counts = value_counts(df, columns)
    total = counts.groupBy("column").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return counts.join(F.broadcast(total), "column").groupBy("column").agg(
        F.count("*").alias("distinct"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), r6(-F.sum(p * F.log2(p))).alias("entropy")
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r of every pair, once each, in one aggregate; high: |r| > 0.5."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    out = stacked(one, [(f"{a}|{b}", [F.round(F.col(f"{a}|{b}"), 6)]) for a, b in pairs], ["r"])
    return out.select(F.split("column", r"\|")[0].alias("a"), F.split("column", r"\|")[1].alias("b"), "r", (F.abs("r") > 0.5).alias("high"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from min to max, the last one closed; a constant column spans +-0.5."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("k"))
    every = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, "bin", "left").select("bin", r6(F.col("lo") + width * F.col("bin")).alias("from"), r6(F.col("lo") + width * (F.col("bin") + 1)).alias("to"), F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def perf_metrics(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Serving metrics of a prediction log, over all of it or by some columns.

    The log has success, latency, relevance, composite, groundedness,
    retrieval, doc_id and index_size; scores of failures may be null.
    """
    by = by or []
    zero = lambda c: r6(F.coalesce(c, F.lit(0.0)))
    one = log.groupBy(*by).agg(
        F.count("*").alias("n"), zero(F.avg((~F.col("success")).cast("double"))).alias("error_rate"), zero(F.avg(F.when(F.col("success"), F.col("latency")))).alias("avg_latency"),
        zero(F.avg("relevance")).alias("avg_relevance"), r6(F.avg("composite")).alias("avg_composite"), r6(F.min("composite")).alias("min_composite"), r6(F.avg("groundedness")).alias("avg_groundedness"),
        r6(F.avg("retrieval")).alias("avg_retrieval"), F.count_distinct("doc_id").alias("distinct_docs"), F.avg("index_size").alias("_size"),
    )
    # the percentile comes from running totals, so no task holds a group's latencies
    p95 = quantiles(log.filter("success"), "latency", [0.95], by=by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("q")[0].alias("_p95"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    out = one.join(p95, same, "left") if by else one.join(F.broadcast(p95), how="left")  # one row each
    return out.select(
        *by, "n", "error_rate", "avg_latency", zero(F.col("_p95")).alias("p95_latency"), "avg_relevance", "avg_composite", "min_composite", "avg_groundedness", "avg_retrieval", "distinct_docs",
        F.round(F.coalesce(100 * F.col("distinct_docs") / F.col("_size"), F.lit(0.0)), 2).alias("coverage"),
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of true x predicted class, zeros included."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("k"))
    classes = counts.select(F.explode(F.array("truth", "predicted")).alias("c")).distinct()
    # class x class, of the label domain, not of rows
    grid = classes.agg(F.sort_array(F.collect_set("c")).alias("cs")).select(F.explode("cs").alias("truth"), "cs").select("truth", F.explode("cs").alias("predicted"))
    return grid.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, f1, support of each class; zero division gives 0."""
    m = confusion(df, truth, predicted)
    rows = m.select(F.explode(F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("tp")),
    )).alias("r")).select("r.*")
    s = rows.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "tp")])
    p, r = F.coalesce(F.try_divide("tp", "called"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return s.select("class", "support", r6(p).alias("precision"), r6(r).alias("recall"), r6(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))).alias("f1"), "tp")


def weighted_metrics(classes: DataFrame) -> DataFrame:
    """Support-weighted means of ``class_metrics`` and the accuracy."""
    w = lambda c: r6(F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)))
    return classes.agg(r6(F.sum("tp") / F.sum("support")).alias("accuracy"), w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1"))


#: Distinct values in a range of ``prefix_counts``.
RANGE_VALUES = 100_000


def prefix_counts(df: DataFrame, value: str, sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(by, v, sums, before_*, all_*): distinct values with sums, their running
    totals before each and their totals, in the order of the values of each ``by``.

    The sums of each value are written once.  They are dealt into ranges of
    (by, v), as many as the values ask for; totals of ranges give offsets, and
    windows run inside a range only.  Null values take no part; a null of
    ``by`` is a group like any other.
    """
    by = by or []
    per = written(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(*[c.alias(n) for n, c in sums.items()]), "per-value")
    ranges = -(-per.count() // RANGE_VALUES)
    if ranges > 1:
        placed = written(per.repartitionByRange(ranges, *by, "v").withColumn("_range", F.spark_partition_id()), "ranges")
    else:
        placed = per.withColumn("_range", F.lit(0))
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])  # a row a range and group that has it
    own = Window.partitionBy(*by)
    upto = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_own"),
        *[F.coalesce(F.sum(f"_t_{n}").over(upto), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.sum(f"_t_{n}").over(own).alias(f"all_{n}") for n in sums],
    )
    inside = Window.partitionBy(*by, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_i_{n}") for n in sums])
    same = F.col("_range") == F.col("_own")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = before.join(offsets, same)
    return out.select(*by, "v", *sums, *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(f"before_{n}") for n in sums], *[f"all_{n}" for n in sums])


def at_shares(counts: DataFrame, shares: list[float], by: list[str] | None = None, disc: bool = False) -> DataFrame:
    """(by, q) from ``prefix_counts`` with the sum k of rows; see ``quantiles``."""
    spots = []
    for p in shares:
        place = F.ceil(F.col("all_k") * p) - 1 if disc else (F.col("all_k") - 1) * F.lit(float(p))
        low = F.greatest(F.floor(place), F.lit(0))
        has = lambda at: (F.col("before_k") <= at) & (at < F.col("before_k") + F.col("k"))
        spots.append((F.max(F.when(has(low), F.col("v"))), F.max(F.when(has(F.least(low + 1, F.col("all_k") - 1)), F.col("v"))), F.max(place - low)))
    one = counts.groupBy(*(by or [])).agg(*[x.alias(f"_{n}{i}") for i, three in enumerate(spots) for n, x in zip("lhw", three)])
    at = lambda i: F.col(f"_l{i}") if disc else F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.greatest(F.col(f"_w{i}"), F.lit(0.0))
    return one.select(*(by or []), F.array(*[at(i) for i in range(len(shares))]).alias("q"))


def quantiles(df: DataFrame, value: str, shares: list[float], disc: bool = False, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each ``by``, with q, the exact quantiles of a column
    at some shares: the values at a place, linear between two places, or with
    ``disc`` the first value that at least the share of the rows doesn't exceed.

    Places come from running totals over ranges, so no task holds all values.
    """
    return at_shares(prefix_counts(df, value, {"k": F.count("*")}, by), shares, by, disc)


def auc_ovr(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """One-vs-rest AUC of each class by its score column, and their mean
    weighted by support, as the row of class "weighted"."""
    each = None
    for name, score in scores.items():
        n = df.agg(F.count_if(F.col(truth) == name).alias("support"))
        one = auc(df, score, F.col(truth) == name).join(F.broadcast(n)).select(F.lit(name).alias("class"), "support", "auc")  # one row each
        each = one if each is None else each.union(one)
    mean = each.agg(F.lit("weighted").alias("class"), F.sum("support").alias("support"), r6(F.try_divide(F.sum(F.col("auc") * F.col("support")), F.sum("support"))).alias("auc"))
    return each.union(mean)


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve: pairs of a positive above a negative, ties half; 0 if a class is missing."""
    c = prefix_counts(df.withColumn("_p", positive.cast("long")), score, {"pos": F.sum("_p"), "neg": F.sum(1 - F.col("_p"))})
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return c.agg(r6(F.coalesce(F.try_divide(won, F.sum("pos") * F.sum("neg")), F.lit(0.0))).alias("auc"))
