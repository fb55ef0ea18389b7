"""Data-quality rules, all evaluated in one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import melt, stacked


def expectations(df: DataFrame, rules: list[tuple[str, str, object]]) -> DataFrame:
    """rule, column, violations, passed of (kind, column, argument) rules.

    between ignores nulls; in_set counts nulls as violations; unique counts
    every row of a value after its first, nulls too.  Rules on columns that
    aren't there are left out.
    """
    rules = [r for r in rules if r[1] in df.columns]
    plain = [(k, c, a) for k, c, a in rules if k != "unique"]
    test = {
        "between": lambda c, a: F.count_if(~F.col(c).between(*a)), "in_set": lambda c, a: F.count_if(F.col(c).isNull() | ~F.col(c).isin(list(a))), "not_null": lambda c, a: F.count_if(F.col(c).isNull()),
    }
    one = df.agg(F.count("*").alias("_n"), *[test[k](c, a).alias(f"r{i}") for i, (k, c, a) in enumerate(plain)])
    out = stacked(one, [(c, [F.lit(k), F.col(f"r{i}")]) for i, (k, c, _) in enumerate(plain)], ["rule", "violations"]) if plain else None
    unique = [c for k, c, _ in rules if k == "unique"]
    if unique:
        per = melt(df, unique).groupBy("column", "value").agg(F.count("*").alias("k")).groupBy("column").agg((F.sum("k") - F.count("*")).alias("violations"))
        per = per.select("column", F.lit("unique").alias("rule"), "violations")
        out = per if out is None else out.union(per)
    return out.withColumn("passed", F.col("violations") == 0)


#: Fewer or more words than these are an anomaly whatever the baseline.
WORDS = (100, 10_000)


def anomalies(df: DataFrame, stats: DataFrame, id_col: str, numeric: list[str], text: list[str], lists: list[str] | None = None, words: str | None = None) -> DataFrame:
    """id and violations of the rows beyond one row of baseline statistics.

    ``stats`` has lo_, hi_ and nulls_ (percent) columns for each column; text
    is short below half the least length and long above twice the greatest; a
    list is too long above twice the greatest.  ``words`` is a column of word
    counts with fixed limits.
    """
    checks = []
    for c in numeric:
        checks += [F.when(F.col(c) < F.col(f"lo_{c}"), f"{c} below min"), F.when(F.col(c) > F.col(f"hi_{c}"), f"{c} above max")]
    for c in text:
        n = F.char_length(c)
        checks += [F.when(n < 0.5 * F.col(f"lo_{c}"), f"{c} too short"), F.when(n > 2 * F.col(f"hi_{c}"), f"{c} too long")]
    checks += [F.when(F.size(c) > 2 * F.col(f"hi_{c}"), f"{c} too many") for c in lists or []]
    checks += [F.when(F.col(c).isNull() & (F.col(f"nulls_{c}") < 5), f"{c} is null") for c in [*numeric, *text, *(lists or [])]]
    if words:
        checks += [F.when(F.col(words) < WORDS[0], f"{words} below {WORDS[0]}"), F.when(F.col(words) > WORDS[1], f"{words} above {WORDS[1]}")]
    out = df.join(F.broadcast(stats)).select(id_col, F.array_compact(F.array(*checks)).alias("v"))  # one row of statistics
    return out.filter(F.size("v") > 0).select(id_col, F.array_join("v", "; ").alias("violations"))
