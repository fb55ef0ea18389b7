"""Drift, tests and fairness over grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import chi2_sf, ks_sf
from ..shared import written
from .profile import prefix_counts, r6
from .tables import aligned_counts, salted_rank


def ks(df: DataFrame, value: str, is_new: Column) -> DataFrame:
    """One row (d, n, m): the largest gap between two empirical distributions."""
    rows = df.withColumn("_new", is_new.cast("long"))
    c = prefix_counts(rows, value, {"b": F.sum(1 - F.col("_new")), "w": F.sum("_new")})
    gap = F.abs((F.col("before_b") + F.col("b")) / F.col("all_b") - (F.col("before_w") + F.col("w")) / F.col("all_w"))
    one = c.agg(F.max(gap).alias("d"), F.max("all_b").alias("n"), F.max("all_w").alias("m"))
    return one.withColumn("d", F.when((F.col("n") > 0) & (F.col("m") > 0), F.col("d")))


def with_p(one: DataFrame, kind: str) -> DataFrame:
    """Adds the p-value of a statistic's row or few rows (never of data rows)."""
    f = F.udf((lambda d, n, m: None if d is None else float(ks_sf(d, n, m))) if kind == "ks" else (lambda x, k: None if x is None else float(chi2_sf(x, k))), "double")
    return one.withColumn("p", f("d", "n", "m") if kind == "ks" else f("statistic", "dof"))


def numeric_drift(df: DataFrame, value: str, is_new: Column, shift: float = 0.1, p: float = 0.05) -> DataFrame:
    """mean shift, std ratio, change of the mean in %, KS and drift; no row if a side is empty."""
    rows = df.withColumn("_v", F.col(value).cast("double")).filter("_v is not null")
    base, new = F.when(~is_new, F.col("_v")), F.when(is_new, F.col("_v"))
    m = rows.agg(F.avg(base).alias("mb"), F.avg(new).alias("mn"), F.stddev_samp(base).alias("sb"), F.stddev_samp(new).alias("sn"))
    both = with_p(m.join(F.broadcast(ks(rows, "_v", is_new))), "ks")  # one row each
    out = both.filter("n > 0 and m > 0").select(
        r6(F.abs(F.col("mn") - F.col("mb")) / (F.col("sb") + 1e-7)).alias("mean_shift"), r6(F.try_divide("sn", "sb")).alias("std_ratio"), r6(100 * F.try_divide(F.col("mn") - F.col("mb"), "mb")).alias("mean_change_pct"),
        r6(F.col("d")).alias("ks"), F.col("p"), F.col("n").cast("long").alias("n_base"), F.col("m").cast("long").alias("n_new"),
    )
    return out.withColumn("drift", (F.col("mean_shift") > shift) | (F.abs(F.col("std_ratio") - 1) > shift) | (F.col("p") < p)).withColumn("p", r6(F.col("p")))


def _listed(df: DataFrame, item: Column, order: list[Column], most: int, name: str) -> DataFrame:
    """One row: the first ``most`` items of an order, joined by commas."""
    few = df.orderBy(*order).limit(most).select(item.alias("i"))
    return few.agg(F.array_join(F.sort_array(F.collect_list("i")), ",").alias(name))


def chi2_drift(base: DataFrame, new: DataFrame, column: str, alpha: float = 0.05, common: bool = False) -> DataFrame:
    """Chi-square of two frequency tables, both scaled to the larger total.

    With ``common`` the test needs more than one category that both sides
    have, else more than one on each side; without a test, any new or missing
    category is drift.  Also the five most frequent of each side and the first
    ten new and missing categories, as sorted lists.  Both tables are read once:
    their counts, a row a category, are written.
    """
    c = written(aligned_counts(base, new, column), "counts")
    t = c.agg(F.sum("base_n").alias("tb"), F.sum("new_n").alias("tn"))  # one row
    big = F.greatest("tb", "tn")
    e, o = F.greatest(F.col("base_n") / F.col("tb") * big, F.lit(1e-10)), F.greatest(F.col("new_n") / F.col("tn") * big, F.lit(1e-10))
    one = c.join(F.broadcast(t)).agg(
        F.sum((o - e) * (o - e) / e).alias("statistic"), (F.count("*") - 1).cast("int").alias("dof"), F.count_if(F.col("base_n") == 0).alias("new_categories"), F.count_if(F.col("new_n") == 0).alias("missing_categories"),
        F.count_if(F.col("base_n") > 0).alias("base_distinct"), F.count_if(F.col("new_n") > 0).alias("new_distinct"), F.count_if((F.col("base_n") > 0) & (F.col("new_n") > 0)).alias("both"),
    )
    tested = (F.col("both") > 1) if common else (F.col("base_distinct") > 1) & (F.col("new_distinct") > 1)
    changed = (F.col("new_categories") > 0) | (F.col("missing_categories") > 0)
    one = with_p(one.withColumn("statistic", F.when(tested, F.col("statistic"))), "chi2")
    one = one.withColumn("drift", F.when(tested, F.col("p") < alpha).otherwise(changed)).withColumn("p", r6(F.col("p"))).drop("both")
    value = F.col("value").cast("string")
    shown = lambda n: F.concat(value, F.lit(":"), F.col(n).cast("string"))
    for name, rows, item, order, most in (
        ("top_base", c.filter("base_n > 0"), shown("base_n"), [F.desc("base_n"), value], 5), ("top_new", c.filter("new_n > 0"), shown("new_n"), [F.desc("new_n"), value], 5),
        ("new_values", c.filter("base_n = 0"), value, [value], 10), ("missing_values", c.filter("new_n = 0"), value, [value], 10),
    ):
        one = one.join(F.broadcast(_listed(rows, item, order, most, name)))  # one row each
    return one


def chi2_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of a contingency table; Yates' correction on 2 x 2."""
    n = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")).filter("a is not null and b is not null")
    ra, rb = n.groupBy("a").agg(F.sum("n").alias("ra")), n.groupBy("b").agg(F.sum("n").alias("rb"))
    t = n.agg(F.sum("n").alias("t"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))  # one row
    # zero cells add their expectation: the sum over seen cells is completed by what is left of the total
    j = n.join(ra, "a").join(rb, "b").join(F.broadcast(t))
    e = F.col("ra") * F.col("rb") / F.col("t")
    yates = (F.col("ka") == 2) & (F.col("kb") == 2)
    diff = F.when(yates, F.greatest(F.abs(F.col("n") - e) - 0.5, F.lit(0.0))).otherwise(F.abs(F.col("n") - e))
    one = j.agg((F.sum(diff * diff / e) + F.first("t") - F.sum(e)).alias("statistic"), ((F.first("ka") - 1) * (F.first("kb") - 1)).cast("int").alias("dof"))
    return with_p(one, "chi2").withColumn("independent", F.col("p") > 0.05).withColumn("p", r6(F.col("p")))


def cohens_d(df: DataFrame, value: str, first: Column) -> DataFrame:
    """|difference of means| / pooled sample std of rows that are first and that aren't."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    one = df.agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return one.select("na", "nb", r6(F.when((F.col("na") < 2) | (F.col("nb") < 2) | (pooled == 0), 0.0).otherwise(F.abs(F.col("ma") - F.col("mb")) / pooled)).alias("d"))


def group_shares(df: DataFrame, group: str) -> DataFrame:
    """Count of each group, its share of the largest (disparate below 0.8) and
    how far the counts are from uniform (fair below 0.3)."""
    n = df.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"))
    t = n.agg(F.max("n").alias("top"), F.avg("n").alias("mean"), F.max("n").alias("hi"), F.min("n").alias("lo"))  # one row
    gap = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) / F.col("mean")
    return n.join(F.broadcast(t)).select("grp", "n", r6(F.col("n") / F.col("top")).alias("impact"), (F.col("n") / F.col("top") < 0.8).alias("disparate"), r6(gap).alias("deviation"), (gap < 0.3).alias("fair"))


def slices(df: DataFrame, features: list[str], carry: list[str]) -> DataFrame:
    """A row per row and feature: feature, value and the carried columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    return df.select(*carry, F.explode(pairs).alias("_s")).select("_s.*", *carry)


def slice_finder(df: DataFrame, features: list[str], numerics: list[str], target: str, least: int = 30, most: int = 10) -> DataFrame:
    """Slices whose share, nulls, numeric means or target distribution stand out."""
    carry = [*numerics, target]
    long = slices(df, features, carry).filter("value is not null")
    total = df.agg(F.count("*").alias("_n"), *[x for c in numerics for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))], *[(F.count_if(F.col(c).isNull()) / F.count("*")).alias(f"_0_{c}") for c in numerics])  # one row
    kinds = long.groupBy("feature").agg(F.count_distinct("value").alias("_k"))
    agg = long.groupBy("feature", "value").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in numerics], *[(F.count_if(F.col(c).isNull()) / F.count("*")).alias(f"0_{c}") for c in numerics])
    # half the L1 distance of target distributions
    cells = long.groupBy("feature", "value", target).agg(F.count("*").alias("c"))
    overall = df.groupBy(target).agg(F.count("*").alias("_t"))
    part = cells.join(overall, target).join(agg.select("feature", "value", "n"), ["feature", "value"]).join(F.broadcast(total.select("_n")))
    own, all_ = F.col("c") / F.col("n"), F.col("_t") / F.col("_n")
    score = part.groupBy("feature", "value").agg((0.5 * (F.sum(F.abs(own - all_)) + 1 - F.sum(all_))).alias("score"))
    j = agg.filter(F.col("n") >= least).join(F.broadcast(total)).join(F.broadcast(kinds), "feature").join(score, ["feature", "value"])
    share = F.col("n") / F.col("_n")
    issues = (F.abs(share - 1 / F.col("_k")) > 0.1).cast("int")
    for c in numerics:
        issues = issues + (F.abs(F.col(f"0_{c}") - F.col(f"_0_{c}")) > 0.05).cast("int")
    for c in numerics[:3]:
        issues = issues + F.coalesce((F.abs(F.col(f"m_{c}") - F.col(f"_m_{c}")) / F.col(f"_s_{c}") > 2).cast("int"), F.lit(0))
    out = j.select("feature", "value", "n", r6(share).alias("share"), issues.alias("issues"), r6(F.col("score")).alias("score"), F.when(issues > 2, "high").otherwise("medium").alias("severity"))
    return out.filter("issues > 0").orderBy(F.desc("issues"), "feature", "value").limit(most)


def positive_rate_slices(df: DataFrame, features: list[str], positive: Column, least: int = 30, gap: float = 0.2) -> DataFrame:
    """Slices whose positive rate is more than ``gap`` off the overall one, relatively."""
    rows = df.withColumn("_p", positive.cast("double"))
    total = rows.agg(F.avg("_p").alias("all"))  # one row
    s = slices(rows, features, ["_p"]).groupBy("feature", "value").agg(F.count("*").alias("n"), F.avg("_p").alias("rate")).filter(F.col("n") >= least)
    off = F.abs(F.col("rate") - F.col("all")) / F.col("all")
    return s.join(F.broadcast(total)).filter(off > gap).select("feature", "value", "n", r6(F.col("rate")).alias("rate"), r6(off).alias("deviation"), F.when(off > 0.5, "high").otherwise("medium").alias("severity"))


RATES = {
    "accuracy": ("tp + tn", "n"), "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "selection_rate": ("tp + fp", "n"), "fpr": ("fp", "fp + tn"), "fnr": ("fn", "tp + fn"), "tpr": ("tp", "tp + fn"), "tnr": ("tn", "fp + tn"),
    "f1": ("2 * tp", "2 * tp + fp + fn"),
}


def metric_frame(df: DataFrame, group: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Rates of a binary prediction by group; zero division gives 0."""
    cells = {"tp": truth & predicted, "fp": ~truth & predicted, "fn": truth & ~predicted, "tn": ~truth & ~predicted}
    g = df.groupBy(*group).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in cells.items()])
    return g.select(*[c for c in g.columns if c not in cells], *[r6(F.coalesce(F.try_divide(F.expr(a).cast("double"), F.expr(b)), F.lit(0.0))).alias(k) for k, (a, b) in RATES.items()])


def with_summary(frame: DataFrame, overall: DataFrame, group: str) -> DataFrame:
    """A metric frame with a row "overall" and one of the largest differences."""
    gaps = frame.agg(F.lit("difference").alias(group), F.sum("n").alias("n"), *[r6(F.max(c) - F.min(c)).alias(c) for c in RATES])
    return frame.unionByName(overall.select(F.lit("overall").alias(group), "n", *RATES)).unionByName(gaps)


def weighted_frame(df: DataFrame, group: list[str], truth: Column, predicted: Column) -> DataFrame:
    """n, accuracy, selection rate and precision, recall and F1 weighted by the
    support of both classes, by group; zero division gives 0."""
    cells = {"tp": truth & predicted, "fp": ~truth & predicted, "fn": truth & ~predicted, "tn": ~truth & ~predicted}
    g = df.groupBy(*group).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in cells.items()])
    part = lambda a, b: f"coalesce(try_divide(cast({a} as double), {b}), 0)"
    both = lambda a, b: r6(F.expr(f"((tp + fn) * {a} + (tn + fp) * {b}) / n"))
    return g.select(
        *group, "n", r6(F.expr("(tp + tn) / n")).alias("accuracy"), r6(F.expr("(tp + fp) / n")).alias("selection_rate"), both(part("tp", "tp + fp"), part("tn", "tn + fn")).alias("precision"),
        both(part("tp", "tp + fn"), part("tn", "tn + fp")).alias("recall"), both(part("2 * tp", "2 * tp + fp + fn"), part("2 * tn", "2 * tn + fp + fn")).alias("f1"),
    )


def fairness(frame: DataFrame) -> DataFrame:
    """Parity and odds gaps of a metric frame."""
    gap = lambda c: F.max(c) - F.min(c)
    ratio = lambda c: F.coalesce(F.try_divide(F.min(c), F.max(c)), F.lit(0.0))
    one = frame.agg(
        r6(gap("selection_rate")).alias("dp_difference"), r6(ratio("selection_rate")).alias("dp_ratio"), r6(F.greatest(gap("tpr"), gap("fpr"))).alias("eo_difference"), r6(F.least(ratio("tpr"), ratio("fpr"))).alias("eo_ratio"), r6(gap("accuracy")).alias("accuracy_gap"),
    )
    return one.withColumns({"dp_flag": F.col("dp_difference") > 0.1, "eo_flag": F.col("eo_difference") > 0.1, "accuracy_flag": F.col("accuracy_gap") > 0.1})


def disparities(frame: DataFrame, threshold: float = 0.05, wide: float = 0.1) -> DataFrame:
    """Ranges and population std of slice metrics by feature, worst and best
    slice, violations of both thresholds; features with one slice are left out."""
    gap = lambda c: F.max(c) - F.min(c)
    g = frame.groupBy("feature").agg(
        F.count("*").alias("slices"), *[r6(gap(c)).alias(f"{c}_range") for c in ("accuracy", "f1", "fpr", "fnr")], *[r6(F.stddev_pop(c)).alias(f"{c}_std") for c in ("accuracy", "f1")],
        F.min(F.struct("accuracy", "value"))["value"].alias("worst"), F.min(F.struct((-F.col("accuracy")).alias("a"), "value"))["value"].alias("best"),
    ).filter("slices >= 2")
    over = lambda t: F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{c}_range") > t, F.lit(c)) for c in ("accuracy", "f1", "fpr", "fnr")])), ",")
    return g.withColumn("violations", over(threshold)).withColumn("wide_violations", over(wide))


def resample(df: DataFrame, group: str, id_col: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Every group at int((n // k) * share) rows: larger ones are cut without,
    smaller ones topped up with replacement; places are by md5(id, seed).

    A row of a small group is repeated as often as its place asks for.
    """
    ranked = salted_rank(df, [group], F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed)))))
    t = df.groupBy(group).agg(F.count("*").alias("c")).agg(F.floor(F.floor(F.sum("c") / F.count("*")) * share).cast("long").alias("target"))  # one row
    r = ranked.join(F.broadcast(t))
    # row at place r of a group of c is taken for places r, r + c, r + 2c, ... up to the target
    times = F.floor((F.col("target") - F.col("rank")) / F.col("group_size")) + 1
    return r.filter(F.col("rank") <= F.col("target")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("rank", "group_size", "target")


def weights(df: DataFrame, features: list[str]) -> DataFrame:
    """Product over features of n / (k count), divided by its mean."""
    out, total = df, df.agg(F.count("*").alias("_n"))
    for f in features:
        c = df.groupBy(f).agg(F.count("*").alias(f"_c_{f}"))
        k = c.agg(F.count("*").alias(f"_k_{f}"))
        out = out.join(c, f).join(F.broadcast(k))
    w = F.lit(1.0)
    for f in features:
        w = w * F.col("_n") / (F.col(f"_k_{f}") * F.col(f"_c_{f}"))
    out = out.join(F.broadcast(total)).withColumn("_w", w)
    mean = out.agg(F.avg("_w").alias("_mean"))  # one row
    return out.join(F.broadcast(mean)).withColumn("weight", r6(F.col("_w") / F.col("_mean"))).select(*df.columns, "weight")


def group_thresholds(df: DataFrame, group: str, score: str, truth: Column, grid: int = 20, constraint: str = "parity") -> DataFrame:
    """Per group the threshold of an even grid with the best accuracy whose gap
    is within 0.1 (the least gap if none is).

    With ``parity`` the gap is that of the selection rate to the overall
    positive rate.  With ``odds`` it is the larger of the gaps of true and of
    false positive rate to those which the most accurate common threshold has
    over the groups of both labels.  A group with one label keeps 0.5; it has
    no gap of odds.  Scores are from 0 to 1."""
    rows = df.select(F.col(group).alias("grp"), F.least(F.floor(F.col(score) * grid), F.lit(grid - 1)).cast("int").alias("bin"), truth.cast("long").alias("y"))
    per = rows.groupBy("grp", "bin").agg(F.count("*").alias("c"), F.sum("y").alias("p"))  # grid rows a group at most
    cut = per.select("grp", "c", "p", "bin", F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("t"))
    up = F.col("bin") >= F.col("t")
    s = cut.groupBy("grp", "t").agg(F.sum(F.when(up, F.col("c")).otherwise(0)).alias("called"), F.sum(F.when(up, F.col("p")).otherwise(0)).alias("tp"), F.sum("c").alias("n"), F.sum("p").alias("pos"))
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    right = lambda f: (f("tp") + (f("n") - f("called")) - (f("pos") - f("tp"))) / f("n")
    if constraint == "parity":
        s = s.join(F.broadcast(per.agg((F.sum("p") / F.sum("c")).alias("base"))))  # one row
        gap = F.abs(F.col("called") / F.col("n") - F.col("base"))
    elif constraint == "odds":
        rates = s.filter(both).groupBy("t").agg(F.round(-right(F.sum), 9).alias("wrong"), (F.sum("tp") / F.sum("pos")).alias("tpr"), ((F.sum("called") - F.sum("tp")) / (F.sum("n") - F.sum("pos"))).alias("fpr"))
        s = s.join(F.broadcast(rates.agg(F.min(F.struct("wrong", "t", "tpr", "fpr")).alias("aim"))))  # one row
        off = lambda part, of, rate: F.abs(F.try_divide(part, of) - F.col(rate))
        gap = F.when(both, F.greatest(off(F.col("tp"), F.col("pos"), "aim.tpr"), off(F.col("called") - F.col("tp"), F.col("n") - F.col("pos"), "aim.fpr")))
    else:
        raise ValueError(f"unknown constraint {constraint!r}")
    s = s.filter(both | (F.col("t") == grid // 2)).withColumn("gap", F.round(gap, 9)).withColumn("acc", F.round(right(F.col), 9))
    best = F.min(F.struct(F.when(F.col("gap") <= 0.1, 0).otherwise(1).alias("miss"), F.when(F.col("gap") <= 0.1, -F.col("acc")).otherwise(F.col("gap")).alias("k"), "t", "acc", "gap"))
    out = s.groupBy("grp").agg(best.alias("b"), F.first("n").alias("n"))
    return out.select("grp", "n", r6(F.col("b.t") / grid).alias("threshold"), r6(F.col("b.acc")).alias("accuracy"), r6(F.col("b.gap")).alias("gap"))
