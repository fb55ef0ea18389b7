"""Optimal group thresholds: constraints hold exactly, and no rule of the kind is better."""

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plumbline.operators import stats as ST
from plumbline.operators import thresholds as TH


def brute_hull(points):
    """Vertices: points over no segment of which they lie on or under."""
    top = {}
    for x, y in points:
        top[x] = max(y, top.get(x, y))
    out = []
    for x, y in sorted(top.items()):
        if not any(a < x < b and (y - top[a]) * (b - a) <= (top[b] - top[a]) * (x - a) for a, b in itertools.combinations(sorted(top), 2)):
            out.append((x, y))
    return out


def test_upper_hull():
    rng = random.Random(1)
    for _ in range(200):
        points = [(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randint(1, 25))]
        assert TH.upper_hull(points) == brute_hull(points)


def brute_value(points, x):
    """The greatest y of any mix of two points at x."""
    best = None
    for (a, ya), (b, yb) in itertools.product(points, repeat=2):
        if a <= x <= b:
            y = max(ya, yb) if a == b else ya + (yb - ya) * (x - a) / (b - a)
            best = y if best is None else max(best, y)
    return best


def rows_of(rng, groups, most=25):
    return [(g, rng.randrange(8) / 8, rng.randrange(2)) for g in groups for _ in range(rng.randint(4, most))]


def curve(rows, g, parity):
    own = [(s, y) for h, s, y in rows if h == g]
    pos, neg = sum(y for _, y in own), sum(1 - y for _, y in own)
    out = []
    for cut in [9, *{s for s, _ in own}]:
        tp, fp = sum(y for s, y in own if s >= cut), sum(1 - y for s, y in own if s >= cut)
        out.append((Fraction(tp + fp, len(own)), Fraction(tp, len(own))) if parity else (Fraction(fp, neg), Fraction(tp, pos)))
    return out, pos, neg


@pytest.mark.parametrize("constraint", ["parity", "odds"])
@pytest.mark.parametrize("chunk", [200_000, 5])
def test_optimum(spark, constraint, chunk, monkeypatch):
    monkeypatch.setattr(TH, "CHUNK_ROWS", chunk)
    rng = random.Random(chunk)
    for _ in range(2):
        groups = ["a", "b", None]
        rows = rows_of(rng, groups) + [(g, s, y) for g in groups for s, y in ((0.5, 0), (0.25, 1))]
        df = spark.createDataFrame(rows + [("a", None, 1), ("a", 0.5, None)], "g string, s double, y int")
        got = TH.optimal_thresholds(df, "g", "s", F.col("y") == 1, constraint).collect()
        curves = [curve(rows, g, constraint == "parity") for g in groups]
        # every place of a fine grid, besides the bends: none is better
        xs = {x for points, _, _ in curves for x, _ in points} | {Fraction(k, 500) for k in range(501)}
        if constraint == "parity":
            best = max(sum((p + n) * (2 * brute_value(points, x) - x) + n for points, p, n in curves) for x in xs) / len(rows)
        else:
            pos, neg = sum(p for _, p, _ in curves), sum(n for _, _, n in curves)
            best = max(pos * min(brute_value(points, x) for points, _, _ in curves) + neg * (1 - x) for x in xs) / len(rows)
        assert all(r.overall >= float(best) - 1e-12 for r in got) and len(got) == 3
        # the expected rates of each rule, counted from the rows
        rates = []
        for r in got:
            own = [(s, y) for h, s, y in rows if h == r.grp]
            called = lambda s, cut: cut is not None and s >= cut
            share = lambda s: (1 - r.ignored) * (r.share_high * called(s, r.high) + (1 - r.share_high) * called(s, r.low)) + r.ignored * r.base
            tp, fp = sum(share(s) for s, y in own if y), sum(share(s) for s, y in own if not y)
            pos = sum(y for _, y in own)
            assert r.selection == pytest.approx((tp + fp) / len(own)) and r.tpr == pytest.approx(tp / pos) and r.fpr == pytest.approx(fp / (len(own) - pos))
            assert r.accuracy == pytest.approx((tp + len(own) - pos - fp) / len(own))
            rates.append((r.selection,) if constraint == "parity" else (r.tpr, r.fpr))
        assert all(max(c) - min(c) < 1e-9 for c in zip(*rates))
        # not below what common thresholds of a grid reach under the same constraint
        grid = ST.group_thresholds(df.filter("s is not null and y is not null"), "g", "s", F.col("y") == 1, constraint=constraint).collect()
        if max(r.gap for r in grid) < 1e-9:
            assert got[0].overall >= sum(r.n * r.accuracy for r in grid) / sum(r.n for r in grid) - 1e-6


def test_one_label_and_nothing(spark):
    rows = [("a", 0.1, 0), ("a", 0.9, 1), ("b", 0.3, 1), ("b", 0.7, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    odds = TH.optimal_thresholds(df, "g", "s", F.col("y") == 1, "odds").collect()
    assert [(r.grp, r.tpr, r.fpr, r.accuracy) for r in odds] == [("a", 1.0, 0.0, 1.0)]
    parity = {r.grp: r for r in TH.optimal_thresholds(df, "g", "s", F.col("y") == 1).collect()}
    assert parity["a"].selection == parity["b"].selection and parity["b"].fpr is None
    assert parity["a"].overall == 0.75
    for kind in ("odds", "parity"):
        assert TH.optimal_thresholds(df.filter("false"), "g", "s", F.col("y") == 1, kind).count() == 0
    with pytest.raises(ValueError):
        TH.optimal_thresholds(df, "g", "s", F.col("y") == 1, "other")
