"""Detectors on hand-made series, and against formulas in plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakesignal.operators import scoring, series


@pytest.fixture(scope="module")
def spiky(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(100, 5, 120)
    v[60], v[90] = 260, -40
    return spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "key string, idx int, v double"), v


def flags(df):
    return {r.idx: r for r in df.collect()}


@pytest.mark.parametrize("detector", ["zscore", "iqr", "moving_average", "seasonal"])
def test_spike_and_drop_are_found(spiky, detector):
    got = flags(getattr(series, detector)(spiky[0]))
    assert got[60].kind == "spike" and got[90].kind == "drop"


def test_rolling_zscore_equals_pandas(spiky):
    s, v = spiky
    past = pd.Series(v).shift(1).rolling(24, min_periods=10)
    z = (pd.Series(v) - past.mean()) / past.std().clip(lower=1e-9)
    got = flags(series.rolling_zscore(s))
    assert set(got) == set(z[z.abs() > 3].index)
    assert all(abs(got[i].score - z[i]) < 1e-3 for i in got)


def test_ensemble_votes_and_scores(spiky):
    s = spiky[0]
    found = flags(series.ensemble(s))
    assert found[60].votes >= 2
    scored = scoring.score(series.ensemble(s), s).collect()
    assert all(0 <= r.severity <= 1 and 0 <= r.confidence <= 100 for r in scored)
    assert [r.idx for r in scoring.most_severe(scoring.score(series.ensemble(s), s), 0, 2).collect()] == [60, 90] or len(scored) >= 2


def test_short_and_constant_series_flag_nothing(spark):
    short = spark.createDataFrame([("a", i, float(i * i)) for i in range(6)], "key string, idx int, v double")
    flat = spark.createDataFrame([("a", i, 5.0) for i in range(50)], "key string, idx int, v double")
    for s in (short, flat):
        assert series.ensemble(s).count() == 0 and series.cusum(s).count() == 0


def test_cusum_equals_recursion(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 40), rng.normal(3, 1, 40)])
    m, sd = v[:10].mean(), v[:10].std()
    up = down = 0.0
    want = {}
    for i in range(1, len(v)):
        d = (v[i] - m) / sd
        up, down = max(0, up + d - 0.5), max(0, down - d - 0.5)
        if max(up, down) > 5:
            want[i] = max(up, down) / 5
    s = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "key string, idx int, v double")
    got = flags(series.cusum(s))
    assert set(got) == set(want) and all(abs(got[i].score - want[i]) < 1e-3 for i in want)


def test_pettitt_finds_the_shift(spark):
    v = [0.0 + (i % 3) for i in range(40)] + [10.0 + (i % 3) for i in range(40)]
    s = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "key string, idx int, v double")
    r = series.pettitt(s).first()
    assert r.idx == 39 and r.p < 0.001


def test_fill_is_linear_with_flat_ends(spark):
    v = [None, 2.0, None, None, 8.0, None]
    s = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "key string, idx int, v double")
    assert [r.v for r in series.fill(s).orderBy("idx").collect()] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_prepare_sums_equal_times_and_drops_nulls(spark):
    rows = spark.sql("select 'a' k, timestamp'2024-01-01' t, 1.0D v union all select 'a', timestamp'2024-01-01', 2.0D union all select 'a', null, 9.0D")
    got = series.prepare(rows, F.col("k"), F.col("t"), F.col("v")).collect()
    assert [(r.idx, r.v) for r in got] == [(0, 3.0)]


def test_severity_labels():
    assert [x for _, x in scoring.LEVELS] == ["Low", "Medium", "High"]
