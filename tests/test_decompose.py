"""Decomposition by local regression against a plain version that works series by series, and on hand-made series."""

import math
import statistics

import pytest

from lakesignal.operators import decompose


def fit(points, rho, at, q):
    """Value at place `at` of the weighted line through the q nearest of the points at 0, 1, ...; None without weight."""
    n = len(points)
    near = sorted(range(n), key=lambda i: (abs(i - at), i))[: min(q, n)]
    left = min(max(0, at - q // 2), max(0, n - q))
    near = range(left, min(left + q, n))
    h = max(at - near[0], near[-1] - at) + (max(0, q - n) // 2)
    w = {}
    for i in near:
        r = abs(i - at)
        w[i] = (1.0 if r <= 0.001 * h else (1 - (r / h) ** 3) ** 3 if r <= 0.999 * h else 0.0) * rho[i]
    total = sum(w.values())
    if total <= 0:
        return None
    w = {i: x / total for i, x in w.items()}
    mean = sum(x * i for i, x in w.items())
    spread = sum(x * (i - mean) ** 2 for i, x in w.items())
    if math.sqrt(spread) > 0.001 * (n - 1):
        w = {i: x * ((at - mean) * (i - mean) / spread + 1) for i, x in w.items()}
    return sum(x * points[i] for i, x in w.items())


def averages(x, k):
    return [sum(x[i : i + k]) / k for i in range(len(x) - k + 1)]


def plain_stl(y, period, rounds):
    q_season, q_trend, q_low = decompose.spans(period)
    n, trend, rho = len(y), [0.0] * len(y), [1.0] * len(y)
    for turn in range(rounds + 1):
        for _ in range(2 if rounds else 5):
            cycle = {}
            for phase in range(period):
                places = list(range(phase, n, period))
                sub, weights = [y[i] - trend[i] for i in places], [rho[i] for i in places]
                for pos in range(-1, len(sub) + 1):
                    value = fit(sub, weights, pos, q_season)
                    cycle[phase + pos * period] = sub[min(max(pos, 0), len(sub) - 1)] if value is None else value
            low = averages(averages(averages([cycle[i] for i in range(-period, n + period)], period), period), 3)
            season = [cycle[i] - fit(low, [1.0] * n, i, q_low) for i in range(n)]
            rest = [y[i] - season[i] for i in range(n)]
            fits = [fit(rest, rho, i, q_trend) for i in range(n)]
            trend = [rest[i] if fits[i] is None else fits[i] for i in range(n)]
        off = [abs(y[i] - trend[i] - season[i]) for i in range(n)]
        if turn < rounds:
            six = 6 * statistics.median(off)
            rho = [1.0 if r <= 0.001 * six else (1 - (r / six) ** 2) ** 2 if r <= 0.999 * six else 0.0 for r in off]
    return trend, season, rho


def weekly(n=70):
    """Trend and a week's pattern, one point far off."""
    y = [100 + 0.5 * i + 10 * math.sin(2 * math.pi * i / 7) for i in range(n)]
    y[35] = 200.0
    return y


def frame(spark, *series):
    return spark.createDataFrame([(k, i, v) for k, y in enumerate(series) for i, v in enumerate(y)], "key int, idx int, v double")


@pytest.mark.parametrize(("period", "rounds"), [(7, 0), (7, 2), (12, 1)])
def test_equals_the_plain_version(spark, period, rounds):
    series = [weekly(), [math.cos(i * i) + (i % period) for i in range(2 * period + 1)], [float(i % 5 == 0) for i in range(45)]]
    got = {}
    for r in decompose.stl(frame(spark, *series), period, rounds).collect():
        got[r.key, r.idx] = (r.trend, r.seasonal, r.rho)
        assert r.residual == pytest.approx(r.v - r.trend - r.seasonal, abs=1e-9)
    assert len(got) == sum(map(len, series))
    for key, y in enumerate(series):
        want = plain_stl(y, period, rounds)
        for i in range(len(y)):
            assert got[key, i] == pytest.approx([w[i] for w in want], abs=1e-7), (key, i)


def test_planted_outlier_is_found_and_has_no_weight(spark):
    rows = {r.idx: r for r in decompose.stl(frame(spark, weekly()), 7, 3).collect()}
    assert rows[35].rho == 0.0 and rows[35].residual == pytest.approx(200 - 117.5, abs=1.0)
    assert max(abs(r.residual) for i, r in rows.items() if i != 35) < 1.0  # the outlier bends neither trend nor season
    found = decompose.stl_outliers(frame(spark, weekly()), 7, robust_rounds=3).collect()
    assert [(r.idx, r.kind) for r in found] == [(35, "spike")]


def test_short_constant_and_gappy_series(spark):
    gaps = [None if i % 9 == 4 else v for i, v in enumerate(weekly())]
    rows = decompose.stl(frame(spark, [1.0] * 14, [3.0] * 20, gaps), 7, 1).collect()
    assert {r.key for r in rows} == {1, 2}  # two periods are too short
    assert all(abs(r.residual) < 1e-9 and r.trend + r.seasonal == pytest.approx(3.0) for r in rows if r.key == 1)
    assert sum(r.key == 2 for r in rows) == 70
    assert decompose.stl_outliers(frame(spark, [3.0] * 20), 7, robust_rounds=1).count() == 0
    assert decompose.stl(frame(spark), 7, 1).count() == 0


def test_spans():
    assert decompose.spans(7) == (7, 15, 9) and decompose.spans(24) == (13, 41, 25) and decompose.spans(12) == (13, 21, 13)
