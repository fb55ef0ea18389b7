"""Quantile sketches of windows that merge to those of longer windows.

A KLL sketch of a window's values is a few kilobytes whatever their number, so
minutes are kept as they close and hours or days are merged from them, without
the values.  The functions are the same for a batch and for a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .monitor import late

#: Size of a sketch: with 400 a rank is off by less than a hundredth.
K = 400


def sketches(log: DataFrame, value: str, seconds: int, by: list[str] | None = None, ts: str = "ts", k: int = K) -> DataFrame:
    """(start, by, n, sketch) of each window that has a non-null value."""
    rows = late(log, ts).filter(F.col(value).isNotNull())
    g = rows.groupBy(F.window(ts, f"{seconds} seconds").alias("_w"), *(by or []))
    out = g.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))
    return out.select(F.col("_w.start").alias("start"), *(by or []), "n", "sketch")


def rolled(windows: DataFrame, seconds: int, by: list[str] | None = None, k: int = K) -> DataFrame:
    """The sketches of longer windows, merged from those of shorter ones."""
    g = windows.groupBy(F.window("start", f"{seconds} seconds").alias("_w"), *(by or []))
    out = g.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return out.select(F.col("_w.start").alias("start"), *(by or []), "n", "sketch")


def at(windows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``windows`` with a column of each named share's quantile, instead of the sketch."""
    return windows.select(*[c for c in windows.columns if c != "sketch"], *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for n, p in shares.items()])


def off(windows: DataFrame, log: DataFrame, value: str, seconds: int, share: float, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """(start, by, n, error): how far the rank of each window's quantile is from
    ``share``, by the rows themselves; 0 where it lies within the ranks of equal values."""
    by = by or []
    ends = at(windows, {"q": share}).select(F.col("start").alias("_start"), *[F.col(c).alias(f"_{c}") for c in by], "q")
    rows = log.filter(F.col(value).isNotNull()).select(F.window(ts, f"{seconds} seconds")["start"].alias("start"), *by, F.col(value).cast("double").alias("v"))
    same = F.col("start") == F.col("_start")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    j = rows.join(ends, same).groupBy("start", *by).agg(F.count("*").alias("n"), (F.count_if(F.col("v") < F.col("q")) / F.count("*")).alias("under"), (F.count_if(F.col("v") <= F.col("q")) / F.count("*")).alias("upto"))
    return j.select("start", *by, "n", F.greatest(F.col("under") - share, share - F.col("upto"), F.lit(0.0)).alias("error"))
