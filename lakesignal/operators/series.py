"""Detectors over keyed series: DataFrames of (key, idx, v), idx counting each key's points by time.

Every window is partitioned by key, so series are worked on side by side.
A detector returns the points that it flags with a score and a kind ('spike',
'drop' or its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import average_rank

MIN_PERIODS = 10
EDGE = 9  # digits that thresholds are compared at, so that engines agree on them


def by_key():
    return Window.partitionBy("key")


def in_time():
    return by_key().orderBy("idx")


def prepare(df: DataFrame, key: Column, time: Column, value: Column) -> DataFrame:
    """(key, t, idx, v): one point for each key and time (values of equal times are summed), nulls dropped."""
    rows = df.select(key.alias("key"), time.alias("t"), value.cast("double").alias("v")).where("t is not null and v is not null")
    points = rows.groupBy("key", "t").agg(F.round(F.sum("v"), 2).alias("v"))
    return points.withColumn("idx", F.row_number().over(by_key().orderBy("t")) - 1)


def prepare_metrics(df: DataFrame, time: Column, metrics: dict[str, Column]) -> DataFrame:
    """The series of several metrics of one table, each metric a key, so that one run detects in all of them."""
    cells = F.array(*(F.struct(F.lit(m).alias("key"), c.cast("double").alias("v")) for m, c in metrics.items()))
    rows = df.select(time.alias("t"), F.explode(cells).alias("x"))
    return prepare(rows, F.col("x.key"), F.col("t"), F.col("x.v"))


def long_series(s: DataFrame, least: int = MIN_PERIODS) -> DataFrame:
    """The series with at least so many points."""
    return s.withColumn("_n", F.count("v").over(by_key())).where(F.col("_n") >= least).drop("_n")


def _direction(score: Column, prefix: str = "") -> Column:
    return F.when(score > 0, prefix + "spike").otherwise(prefix + "drop")


def _flag(s: DataFrame, score: Column, threshold: float, prefix: str = "") -> DataFrame:
    out = s.withColumn("score", F.round(score, EDGE)).where(F.abs("score") > threshold)
    return out.withColumn("kind", _direction(F.col("score"), prefix)).select("key", "idx", "v", F.round("score", 4).alias("score"), "kind")


def zscore(s: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Distance from the series' mean in sample standard deviations; constant series flag nothing."""
    sd = F.stddev_samp("v").over(by_key())
    return _flag(long_series(s), F.when(sd > 0, (F.col("v") - F.avg("v").over(by_key())) / sd), threshold)


def rolling_zscore(s: DataFrame, window: int = 24, threshold: float = 3.0, min_periods: int = MIN_PERIODS) -> DataFrame:
    """The same against the window before each point, the point itself left out."""
    past = in_time().rowsBetween(-window, -1)
    mean, sd, n = F.avg("v").over(past), F.stddev_samp("v").over(past), F.count("v").over(past)
    score = F.when(n >= min(min_periods, window), (F.col("v") - mean) / F.greatest(sd, F.lit(1e-9)))
    return _flag(long_series(s), score, threshold)


def moving_average(s: DataFrame, window: int = 7, threshold: float = 3.0, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Deviation from the mean of the past window."""
    return rolling_zscore(s, window, threshold, min_periods)


def iqr(s: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Points outside the quartile fences; the score is the distance past the fence in IQRs, drops are negative."""
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).over(by_key())
    rows = long_series(s).withColumn("q", q)
    span = F.col("q")[1] - F.col("q")[0]
    low, high = F.col("q")[0] - multiplier * span, F.col("q")[1] + multiplier * span
    past = F.when(F.col("v") > high, (F.col("v") - high) / span).when(F.col("v") < low, (F.col("v") - low) / span)
    return _flag(rows.where(span > 0), past, 0.0)


def seasonal_residual(s: DataFrame, period: int = 7) -> DataFrame:
    """s with trend (centred rolling median over max(3, period) points) and residual."""
    w = max(3, period)
    around = in_time().rowsBetween(-(w // 2), (w - 1) // 2)
    out = s.withColumn("trend", F.percentile("v", F.lit(0.5)).over(around))
    return out.withColumn("residual", F.col("v") - F.col("trend"))


def seasonal(s: DataFrame, period: int = 7, threshold: float = 3.5) -> DataFrame:
    """Z-score of the residual."""
    rows = seasonal_residual(long_series(s, max(MIN_PERIODS, 2 * period)), period)
    sd = F.stddev_samp("residual").over(by_key())
    return _flag(rows, F.when(sd > 0, (F.col("residual") - F.avg("residual").over(by_key())) / sd), threshold)


def aligned(s: DataFrame, groups: DataFrame) -> DataFrame:
    """s with the group (key, idx, grp) of each point; points without a group or value are left out."""
    return s.join(groups.where(F.col("grp").isNotNull()), ["key", "idx"]).where(F.col("v").isNotNull())


def contextual(s: DataFrame, group: Column, threshold: float = 2.0) -> DataFrame:
    """Z-score within each (key, group); groups with fewer than MIN_PERIODS points flag nothing."""
    rows = s.withColumn("grp", group)
    w = Window.partitionBy("key", "grp")
    sd, n = F.stddev_samp("v").over(w), F.count("v").over(w)
    score = F.when((sd > 0) & (n >= MIN_PERIODS), (F.col("v") - F.avg("v").over(w)) / sd)
    return _flag(rows, score, threshold, "contextual_")


def collective(s: DataFrame, window: int = 5, threshold: float = 2.5, least: int = 2) -> DataFrame:
    """Runs of at least `least` consecutive points that deviate from the past window; a run's score is its highest."""
    hits = moving_average(s, window, threshold, min_periods=window)
    hits = hits.withColumn("island", F.col("idx") - F.row_number().over(in_time()))
    run = Window.partitionBy("key", "island")
    hits = hits.withColumn("n", F.count("*").over(run)).withColumn("score", F.max(F.abs("score")).over(run))
    return hits.where(F.col("n") >= least).select("key", "idx", "v", "score", F.lit("collective").alias("kind"))


def cusum(s: DataFrame, slack: float = 0.5, limit: float = 5.0, head: int = 10) -> DataFrame:
    """Two-sided cumulative sums of deviations from the first points, clamped at 0; score = sum / limit.

    S+ at i is C_i - min(0, lowest C up to i), C being the running sum of deviation - slack: two windows, no loop.
    """
    base = F.when(F.col("idx") < head, F.col("v"))
    rows = long_series(s, 2 * head).withColumn("m", F.avg(base).over(by_key())).withColumn("sd", F.stddev_pop(base).over(by_key()))
    rows = rows.where("sd > 0").withColumn("d", F.when(F.col("idx") > 0, (F.col("v") - F.col("m")) / F.col("sd")).otherwise(0.0))
    upto = in_time().rowsBetween(Window.unboundedPreceding, 0)
    live = (F.col("idx") > 0).cast("double")
    rows = rows.withColumn("up", F.sum(F.col("d") - slack * live).over(upto)).withColumn("down", F.sum(-F.col("d") - slack * live).over(upto))
    clamp = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(upto))
    rows = rows.withColumn("s_up", F.round(clamp("up"), 6)).withColumn("s_down", F.round(clamp("down"), 6))
    top = F.greatest("s_up", "s_down")
    rows = rows.where(top > limit).withColumn("kind", F.when(F.col("s_up") >= F.col("s_down"), "spike").otherwise("drop"))
    return rows.select("key", "idx", "v", F.round(top / limit, 4).alias("score"), "kind")


def pettitt(s: DataFrame, margin: int = 10) -> DataFrame:
    """Each series' change point: key, idx (last point before it), u, p; U_t = sum of ranks up to t - t(n+1)/2.

    p = 2 exp(-6 K^2 / (n^3 + n^2)) with K = 2 |U|, at most 1; candidates leave `margin` points on both sides.
    """
    rows = long_series(s, 2 * margin).withColumn("r", average_rank("v", ["key"]))
    rows = rows.withColumn("n", F.count("*").over(by_key()).cast("double"))
    t = F.col("idx") + 1
    u = 2 * F.sum("r").over(in_time().rowsBetween(Window.unboundedPreceding, 0)) - t * (F.col("n") + 1)
    rows = rows.withColumn("u", u).where((t >= margin) & (t <= F.col("n") - margin))
    best = rows.groupBy("key").agg(F.max_by(F.struct("idx", "u", "n"), F.struct(F.abs("u"), -F.col("idx"))).alias("b"))
    p = F.least(F.lit(1.0), 2 * F.exp(-6 * F.pow(F.col("b.u"), 2) / (F.pow("b.n", F.lit(3)) + F.pow("b.n", F.lit(2)))))
    return best.select("key", F.col("b.idx").alias("idx"), F.round("b.u", 4).alias("u"), F.round(p, 6).alias("p"))


def change_points(s: DataFrame, significance: float = 0.05, reach: int = 2) -> DataFrame:
    """Points within `reach` of a significant change point, kind 'collective', score .5."""
    found = pettitt(s).where(F.col("p") < significance).select("key", F.col("idx").alias("at"))
    near = s.join(found, "key").where(F.abs(F.col("idx") - F.col("at")) <= reach)
    return near.select("key", "idx", "v", F.lit(0.5).alias("score"), F.lit("collective").alias("kind"))


def fill(s: DataFrame, how: str = "linear") -> DataFrame:
    """Null values filled: 'forward', 'backward', or 'linear' between neighbours with the nearest beyond the ends."""
    before, after = in_time().rowsBetween(Window.unboundedPreceding, 0), in_time().rowsBetween(0, Window.unboundedFollowing)
    last, first = F.last("v", True).over(before), F.first("v", True).over(after)
    if how == "forward":
        return s.withColumn("v", last)
    if how == "backward":
        return s.withColumn("v", first)
    known = F.when(F.col("v").isNotNull(), F.col("idx"))
    left, right = F.last(known, True).over(before), F.first(known, True).over(after)
    line = last + (first - last) * (F.col("idx") - left) / (right - left)
    return s.withColumn("v", F.coalesce("v", line, last, first))


#: Detectors of the ensemble, the order that breaks ties.
DETECTORS = ("zscore", "iqr", "moving_average", "seasonal")


def ensemble(s: DataFrame, thresholds: dict[str, float] | None = None, window: int = 7, period: int = 7) -> DataFrame:
    """Votes of the four detectors by point: votes, kind (majority, ties to the first detector), mean and top |score|.

    All four scores stand side by side in one row, so a series is shuffled once and no votes are joined.
    """
    limits = {"zscore": 3.0, "iqr": 1.5, "moving_average": 3.0, "seasonal": 3.5} | (thresholds or {})
    whole, past, wide = by_key(), in_time().rowsBetween(-window, -1), max(3, period)
    around = in_time().rowsBetween(-(wide // 2), (wide - 1) // 2)
    c, v = F.col, F.col("v")
    rows = s.select(
        "key", "idx", "v", F.count("v").over(whole).alias("n"), F.avg("v").over(whole).alias("m"), F.stddev_samp("v").over(whole).alias("sd"),
        F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).over(whole).alias("q"), F.count("v").over(past).alias("past_n"),
        F.avg("v").over(past).alias("past_m"), F.stddev_samp("v").over(past).alias("past_sd"),
        (v - F.percentile("v", F.lit(0.5)).over(around)).alias("residual"),
    )
    rows = rows.withColumn("res_m", F.avg("residual").over(whole)).withColumn("res_sd", F.stddev_samp("residual").over(whole))
    span = c("q")[1] - c("q")[0]
    low, high = c("q")[0] - limits["iqr"] * span, c("q")[1] + limits["iqr"] * span
    enough = c("n") >= MIN_PERIODS
    scores = {
        "zscore": F.when(enough & (c("sd") > 0), (v - c("m")) / c("sd")),
        "iqr": F.when(enough & (span > 0), F.when(v > high, (v - high) / span).when(v < low, (v - low) / span)),
        "moving_average": F.when(enough & (c("past_n") >= min(MIN_PERIODS, window)), (v - c("past_m")) / F.greatest("past_sd", F.lit(1e-9))),
        "seasonal": F.when((c("n") >= max(MIN_PERIODS, 2 * period)) & (c("res_sd") > 0), (c("residual") - c("res_m")) / c("res_sd")),
    }
    beyond = {**limits, "iqr": 0.0}  # fences are part of its score
    flagged = F.array(*(F.when(F.abs(F.round(scores[d], EDGE)) > beyond[d], F.round(F.round(scores[d], EDGE), 4)) for d in DETECTORS))
    hits = rows.select("key", "idx", "v", F.filter(flagged, lambda x: x.isNotNull()).alias("hits")).where(F.size("hits") > 0)
    spikes = F.size(F.filter("hits", lambda x: x > 0))
    first_is_spike = (2 * spikes > F.size("hits")) | ((2 * spikes == F.size("hits")) & (c("hits")[0] > 0))
    return hits.select(
        "key", "idx", "v", F.size("hits").cast("long").alias("votes"), F.when(first_is_spike, "spike").otherwise("drop").alias("kind"),
        F.round(F.aggregate("hits", F.lit(0.0), lambda t, x: t + F.abs(x)) / F.size("hits"), 6).alias("mean_score"),
        F.array_max(F.transform("hits", F.abs)).alias("max_score"),
    )
