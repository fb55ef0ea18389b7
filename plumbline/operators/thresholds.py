"""Group thresholds at the optimum, randomised where no single threshold meets the constraint.

Running totals of each group's scores are the points of its ROC curve, and the
curve's upper hull is what two thresholds and a coin reach.  Hulls are taken of
bounded chunks of a curve first, then of what those leave, which is the hull of
the whole curve; so only vertices of hulls, not scores, come together.
"""

from __future__ import annotations

import bisect
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import prefix_counts

#: Rows of a group whose points are one chunk.
CHUNK_ROWS = 200_000
_POINT = "grp string, cut double, tp long, fp long, pos long, neg long"
_RESULT = "grp string, n long, low double, high double, share_high double, ignored double, base double, selection double, tpr double, fpr double, accuracy double, overall double"


def upper_hull(points: list[tuple]) -> list[tuple]:
    """Vertices of the upper concave hull of (x, y, ...) points, by x; counts, so exact."""
    out: list[tuple] = []
    for p in sorted(points, key=lambda p: (p[0], -p[1])):
        if out and p[0] == out[-1][0]:
            continue
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) >= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out


def _hull(points: pd.DataFrame, parity: bool) -> pd.DataFrame:
    kept = upper_hull([(int(r.fp) + parity * int(r.tp), int(r.tp), i) for i, r in zip(points.index, points.itertuples())])
    return points.loc[[i for _, _, i in kept]]


def hulls(df: DataFrame, group: str, score: str, truth: Column, parity: bool = False) -> DataFrame:
    """(grp, cut, tp, fp, pos, neg): vertices of each group's hull, of tp over
    fp or, for ``parity``, over all that is called positive.  ``cut`` is the
    least score that is called positive, null where none is."""
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(score).cast("double").alias("s"), truth.cast("long").alias("y")).filter("s is not null and y is not null")
    c = prefix_counts(rows, "s", {"pos": F.sum("y"), "neg": F.sum(1 - F.col("y"))}, ["grp"])
    points = c.select(
        "grp", F.col("v").alias("cut"), (F.col("all_pos") - F.col("before_pos")).alias("tp"), (F.col("all_neg") - F.col("before_neg")).alias("fp"), F.col("all_pos").alias("pos"), F.col("all_neg").alias("neg"),
        F.floor((F.col("before_pos") + F.col("before_neg")) / CHUNK_ROWS).alias("chunk"),
    )
    some = points.groupBy("grp", "chunk").applyInPandas(lambda p: _hull(p, parity).drop(columns="chunk"), _POINT)

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        none = p.iloc[:1].assign(cut=float("nan"), tp=0, fp=0)
        return _hull(pd.concat([none, p], ignore_index=True), parity)

    return some.groupBy("grp").applyInPandas(whole, _POINT).withColumn("cut", F.nanvl("cut", F.lit(None).cast("double")))


class Curve:
    """A group's hull as (x, y) with the thresholds of its vertices."""

    def __init__(self, grp, points: list[tuple], pos: int, neg: int, parity: bool):
        self.grp, self.pos, self.neg, self.n = grp, pos, neg, pos + neg
        # parity: share of rows called positive against share that is rightly so; odds: the ROC curve
        self.points = [(Fraction(fp + tp, self.n), Fraction(tp, self.n), cut) if parity else (Fraction(fp, neg), Fraction(tp, pos), cut) for fp, tp, cut in points]
        self.xs = [x for x, _, _ in self.points]

    def at(self, x: Fraction) -> tuple[Fraction, Fraction, object, object]:
        """(y, share of the higher threshold, the higher, the lower) on the hull at x."""
        k = bisect.bisect_left(self.xs, x)
        if k < len(self.xs) and self.xs[k] == x:
            return self.points[k][1], Fraction(1), self.points[k][2], self.points[k][2]
        (a, ya, high), (b, yb, low) = self.points[k - 1], self.points[k]
        share = (b - x) / (b - a)
        return share * ya + (1 - share) * yb, share, high, low


def meet(curves: list[Curve], parity: bool) -> tuple[Fraction, Fraction | None]:
    """The common x (and y, for odds) with the greatest overall accuracy; ties: the smallest x.

    The accuracy is concave and linear between vertices of the hulls and, for
    odds, their crossings, so the best point is one of those.
    """
    xs = sorted({x for c in curves for x in c.xs})
    if parity:
        best = max(xs, key=lambda x: (sum(c.n * (2 * c.at(x)[0] - x) for c in curves), -x))
        return best, None
    lowest = lambda x: min(c.at(x)[0] for c in curves)
    more = set()
    for a, b in zip(xs, xs[1:]):
        ends = [(c.at(a)[0], c.at(b)[0]) for c in curves]
        for i, (ya, yb) in enumerate(ends):
            for za, zb in ends[:i]:
                if (ya - za) * (yb - zb) < 0:
                    more.add(a + (b - a) * (za - ya) / ((yb - ya) - (zb - za)))
    pos, neg = sum(c.pos for c in curves), sum(c.neg for c in curves)
    best = max(xs + sorted(more), key=lambda x: (pos * lowest(x) - neg * x, -x))
    return best, lowest(best)


def solve(vertices: pd.DataFrame, parity: bool) -> pd.DataFrame:
    curves, out = [], []
    for grp, g in vertices.groupby("grp", dropna=False):
        pos, neg = int(g.pos.iloc[0]), int(g.neg.iloc[0])
        if parity or pos and neg:
            points = sorted((int(f), int(t), None if pd.isna(c) else float(c)) for f, t, c in zip(g.fp, g.tp, g.cut))
            curves.append(Curve(None if pd.isna(grp) else grp, points, pos, neg, parity))
    if not curves:
        return pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])
    x, y = meet(curves, parity)
    for c in curves:
        own, share, high, low = c.at(x)
        if parity:
            right = 2 * own - x + Fraction(c.neg, c.n)
            tp, fp, ignored = own * c.n, (x - own) * c.n, Fraction(0)
            tpr, fpr = (tp / c.pos if c.pos else None), (fp / c.neg if c.neg else None)
        else:
            # a hull above the common point is brought down by calling some rows by a coin of the false positive rate
            ignored = (own - y) / (own - x) if own > y else Fraction(0)
            tpr, fpr = y, x
            right = (c.pos * y + c.neg * (1 - x)) / c.n
        selection = x if parity else (c.pos * y + c.neg * x) / c.n
        out.append((c.grp, c.n, low, high, share, ignored, x, selection, tpr, fpr, right))
    overall = sum(c.n * r[-1] for c, r in zip(curves, out)) / sum(c.n for c in curves)
    rows = [[None if v is None else float(v) if isinstance(v, Fraction) else v for v in (*r, overall)] for r in out]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")])


def optimal_thresholds(df: DataFrame, group: str, score: str, truth: Column, constraint: str = "parity") -> DataFrame:
    """Each group's randomised threshold under a constraint that holds exactly in expectation.

    A row of a group is, with probability ``ignored``, called positive by a
    coin of ``base``; else by the threshold ``high`` with probability
    ``share_high``, else by ``low`` (score at or above it; null calls none).
    ``parity`` makes all selection rates alike, ``odds`` all true and all false
    positive rates; both with the greatest overall accuracy that any such rule
    reaches.  Under odds a group of one label has no rates and no row.  Rows
    with a null score or truth take no part; a null group is a group.  Only
    vertices of the groups' hulls meet in one task.
    """
    if constraint not in ("parity", "odds"):
        raise ValueError(f"unknown constraint {constraint!r}")
    parity = constraint == "parity"
    return hulls(df, group, score, truth, parity).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda v: solve(v, parity), _RESULT)
