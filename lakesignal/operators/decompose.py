"""Robust decomposition of keyed series into trend, season and residual by local regression (STL).

A local regression is a weighted straight line through the q points nearest to a
place, fitted with tricube weights of their distance. Here it is a window
around each row and sums over the window's points, so all places of all series
are fitted at once. Each round of the outer loop lessens the weight of points
with large residuals (bisquare); its result is written to the shared folder, so
plans stay short and a lost executor costs a task of one round.

All windows of a round are partitioned by series. A series has rows for one
period before and after it, where the season is extrapolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settle
from . import series

#: Longest season smoother; outer rounds and passes in each, as statistics packages set them.
MOST_SEASONAL, ROBUST_ROUNDS, ROBUST_PASSES, PLAIN_PASSES = 13, 15, 2, 5


def odd(n: int) -> int:
    return n if n % 2 else n + 1


def spans(period: int, seasonal: int | None = None) -> tuple[int, int, int]:
    """Points in the local regressions of season, trend and low pass."""
    seasonal = odd(max(3, min(period, MOST_SEASONAL) if seasonal is None else seasonal))
    trend = 1.5 * period / (1 - 1.5 / seasonal)
    trend = int(trend) if trend == int(trend) else int(trend) + 1
    return seasonal, odd(trend), odd(period + 1)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def local_line(points: Column, at: Column, n: Column, q: int, nearest: Column) -> Column:
    """The fit at place `at` over points (y, rho) of a window of q rows to both sides, of n points at the places 0 to n - 1.

    The q nearest take part. Without any weight the value `nearest` stands; an
    almost vertical set of points gives their mean.
    """
    left = F.greatest(F.lit(0), F.least(at - (q - 1) // 2, n - q))
    right = F.least(left + q - 1, n - 1)
    reach = F.greatest(at - left, right - at) + F.when(n < q, F.floor((q - n) / 2)).otherwise(0)
    near = F.slice(points, left - F.greatest(F.lit(0), at - q) + 1, F.lit(q))
    facts = F.struct((left - at).alias("first"), reach.cast("double").alias("h"), (0.001 * (n - 1)).alias("flat"), near.alias("near"))

    def fit(c: Column) -> Column:
        def weigh(p: Column, i: Column) -> Column:
            d = i + c["first"]
            tricube = F.pow(1 - F.pow(F.abs(d) / c["h"], F.lit(3)), F.lit(3))
            w = F.when(F.abs(d) <= 0.001 * c["h"], 1.0).when(F.abs(d) <= 0.999 * c["h"], tricube).otherwise(0.0)
            return F.struct(d.cast("double").alias("d"), p["y"].alias("y"), (w * p["rho"]).alias("w"))

        zero = F.struct(*(F.lit(0.0).alias(k) for k in ("w", "d", "dd", "y", "dy")))

        def add(s: Column, p: Column) -> Column:
            return F.struct(
                (s["w"] + p["w"]).alias("w"), (s["d"] + p["w"] * p["d"]).alias("d"), (s["dd"] + p["w"] * p["d"] * p["d"]).alias("dd"),
                (s["y"] + p["w"] * p["y"]).alias("y"), (s["dy"] + p["w"] * p["d"] * p["y"]).alias("dy"),
            )

        def line(s: Column) -> Column:
            mean_d, mean_y = s["d"] / s["w"], s["y"] / s["w"]
            spread = F.greatest(F.lit(0.0), s["dd"] / s["w"] - mean_d * mean_d)
            sloped = F.sqrt(spread) > c["flat"]
            return F.when(s["w"] > 0, F.when(sloped, mean_y - mean_d * (s["dy"] / s["w"] - mean_d * mean_y) / spread).otherwise(mean_y))

        return F.aggregate(F.transform(c["near"], weigh), zero, add, line)

    return F.coalesce(_let(facts, fit), nearest)


def _points(y: Column, rho: Column, real: Column, window) -> Column:
    return F.collect_list(F.when(real, F.struct(y.alias("y"), rho.alias("rho")))).over(window)


def _pass(rows: DataFrame, period: int, q_seasonal: int, q_trend: int, q_low: int) -> DataFrame:
    """One inner pass: season from the detrended series' subseries, less its low pass; trend from the rest."""
    keyed = Window.partitionBy("key").orderBy("idx")
    cycle = Window.partitionBy("key", "phase").orderBy("idx")
    around = lambda w, q: w.rowsBetween(-q, q)
    c = F.col
    bare = F.when(c("real"), c("v") - c("trend"))
    rows = rows.withColumn("_pts", _points(bare, c("rho"), c("real"), around(cycle, q_seasonal)))
    beyond = F.when(c("pos") < 0, F.element_at("_pts", 1)["y"]).otherwise(F.element_at("_pts", -1)["y"])
    fitted = local_line(c("_pts"), c("pos"), c("cycles"), q_seasonal, F.coalesce(bare, beyond))
    rows = rows.withColumn("_cycle", fitted).drop("_pts")

    ahead = keyed.rowsBetween(0, period - 1)
    rows = rows.withColumn("_low", F.avg("_cycle").over(ahead))
    rows = rows.withColumn("_low", F.avg("_low").over(ahead))
    rows = rows.withColumn("_low", F.avg("_low").over(keyed.rowsBetween(-period, 2 - period)))
    rows = rows.withColumn("_pts", _points(c("_low"), F.lit(1.0), c("real"), around(keyed, q_low)))
    low = F.when(c("real"), local_line(c("_pts"), c("idx"), c("n"), q_low, c("_low")))
    rows = rows.withColumn("seasonal", c("_cycle") - low).drop("_pts", "_low", "_cycle")

    level = F.when(c("real"), c("v") - c("seasonal"))
    rows = rows.withColumn("_pts", _points(level, c("rho"), c("real"), around(keyed, q_trend)))
    return rows.withColumn("trend", F.when(c("real"), local_line(c("_pts"), c("idx"), c("n"), q_trend, level))).drop("_pts")


def stl(s: DataFrame, period: int = 7, robust_rounds: int = ROBUST_ROUNDS, seasonal: int | None = None) -> DataFrame:
    """(key, idx, v, trend, seasonal, residual, rho) of series with more than two periods.

    Missing values are filled on straight lines first. With robust_rounds 0
    nothing is weighed down. rho is a point's last weight. Series are worked on
    side by side; one series is one task.
    """
    q = spans(period, seasonal)
    whole = Window.partitionBy("key")
    rows = series.fill(s.select("key", "idx", F.col("v").cast("double").alias("v"))).where(F.col("v").isNotNull())
    rows = rows.withColumn("n", F.count("*").over(whole).cast("int")).where(F.col("n") > 2 * period)
    rows = rows.withColumn("first", F.min("idx").over(whole))
    rows = rows.select("key", (F.col("idx") - F.col("first")).cast("int").alias("idx"), "v", "n", "first")
    steps = F.explode(F.sequence(F.lit(1), F.lit(period)))
    ends = rows.where("idx = 0").select("key", "n", "first", steps.alias("k"))
    none = F.lit(None).cast("double").alias("v")
    for place in (-F.col("k"), F.col("n") + F.col("k") - 1):
        rows = rows.unionByName(ends.select("key", place.cast("int").alias("idx"), none, "n", "first"))
    phase = F.pmod("idx", F.lit(period))
    rows = rows.select(
        "*", F.col("v").isNotNull().alias("real"), phase.alias("phase"), F.floor(F.col("idx") / period).cast("int").alias("pos"),
        F.ceil((F.col("n") - phase) / period).cast("int").alias("cycles"), F.lit(1.0).alias("rho"), F.lit(0.0).alias("trend"), F.lit(0.0).alias("seasonal"),
    )
    for k in range(robust_rounds + 1):
        if k:
            off = F.abs(F.col("v") - F.col("trend") - F.col("seasonal"))
            six = 6 * F.percentile(off, F.lit(0.5)).over(whole)
            share = F.pow(1 - F.pow(F.col("_off") / F.col("_six"), F.lit(2)), F.lit(2))
            weight = F.when(F.col("_off") <= 0.001 * F.col("_six"), 1.0).when(F.col("_off") <= 0.999 * F.col("_six"), share).otherwise(0.0)
            rows = rows.withColumn("_off", off).withColumn("_six", six).withColumn("rho", F.when(F.col("real"), weight).otherwise(1.0)).drop("_off", "_six")
        for _ in range(ROBUST_PASSES if robust_rounds else PLAIN_PASSES):
            rows = _pass(rows, period, *q)
        rows = settle(rows, "stl")
    residual = F.col("v") - F.col("trend") - F.col("seasonal")
    return rows.where("real").select("key", (F.col("idx") + F.col("first")).cast("int").alias("idx"), "v", "trend", "seasonal", residual.alias("residual"), "rho")


def stl_outliers(s: DataFrame, period: int = 7, threshold: float = 3.0, robust_rounds: int = ROBUST_ROUNDS) -> DataFrame:
    """(key, idx, v, score, kind): residuals beyond threshold standard deviations of their series' residuals."""
    whole = Window.partitionBy("key")
    rows = stl(s, period, robust_rounds)
    sd = F.stddev_samp("residual").over(whole)
    return series._flag(rows, F.when(sd > 0, (F.col("residual") - F.avg("residual").over(whole)) / sd), threshold)
