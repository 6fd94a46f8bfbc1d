"""Confidence, severity and summaries of detected points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALGORITHMS = 4
KIND_WEIGHT = {"spike": 1.2, "drop": 1.2, "collective": 1.3, "contextual": 0.9}
LEVELS = ((0.2, "Low"), (0.4, "Medium"), (0.7, "High"))


def confidence(votes: Column, mean_score: Column, relative: Column) -> Column:
    """0 to 100: 60 for the share of votes, 30 for the mean score up to 5, 10 for the relative magnitude up to 1."""
    return 60 * votes / ALGORITHMS + 30 * F.least(mean_score / 5, F.lit(1.0)) + 10 * F.least(relative, F.lit(1.0))


def severity(conf: Column, deviation: Column, kind: Column, peak: Column) -> Column:
    """0 to 1 from confidence and deviation, weighted by kind and by a fifth for peaks."""
    weight = F.lit(1.0)
    for name, w in KIND_WEIGHT.items():
        weight = F.when(kind.startswith(name), w).otherwise(weight)
    base = 0.6 * conf / 100 + 0.4 * F.least(deviation / 6, F.lit(1.0))
    return F.least(F.lit(1.0), base * weight * F.when(peak, 1.2).otherwise(1.0))


def severity_label(s: Column) -> Column:
    out = F.when(s < LEVELS[0][0], LEVELS[0][1])
    for limit, name in LEVELS[1:]:
        out = out.when(s < limit, name)
    return out.otherwise("Critical")


def severity_number(level: Column) -> Column:
    """1 to 4 for Low to Critical."""
    return F.array_position(F.array(*map(F.lit, ("Low", "Medium", "High", "Critical"))), level).cast("int")


def expected_range(s: DataFrame, method: str = "iqr", last: int | None = None) -> DataFrame:
    """(key, low, high): quartile fences (1.5), mean and three deviations, or the 1st to 99th percentile; of the last points if asked for."""
    if last:
        newest = Window.partitionBy("key").orderBy(F.desc("idx"))
        s = s.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    if method == "std":
        m, sd = F.avg("v"), F.stddev_samp("v")
        low, high = m - 3 * sd, m + 3 * sd
    else:
        a, b = (0.25, 0.75) if method == "iqr" else (0.01, 0.99)
        low, high = F.percentile("v", F.lit(a)), F.percentile("v", F.lit(b))
        if method == "iqr":
            low, high = low - 1.5 * (high - low), high + 1.5 * (high - low)
    return s.groupBy("key").agg(F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def peaks(s: DataFrame, window: int = 30) -> DataFrame:
    """s with peak: the value is at or beyond the 1st or 99th percentile of the window that ends with it."""
    w = Window.partitionBy("key").orderBy("idx").rowsBetween(-(window - 1), 0)
    q = F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).over(w)
    return s.withColumn("q", q).withColumn("peak", (F.col("v") >= F.col("q")[1]) | (F.col("v") <= F.col("q")[0])).drop("q")


def score(found: DataFrame, s: DataFrame) -> DataFrame:
    """Ensemble points with expected range, confidence, severity and its label, most severe first within a key's order."""
    median = s.groupBy("key").agg(F.percentile("v", F.lit(0.5)).alias("median"))
    rows = found.join(peaks(s).select("key", "idx", "peak"), ["key", "idx"]).join(median, "key")
    rows = rows.join(expected_range(s), "key")
    relative = F.abs(F.col("v") - F.col("median")) / F.greatest(F.abs("median"), F.lit(1e-10))
    rows = rows.withColumn("confidence", F.round(confidence(F.col("votes"), F.col("mean_score"), relative), 4))
    rows = rows.withColumn("severity", F.round(severity(F.col("confidence"), F.col("max_score"), F.col("kind"), F.col("peak")), 4))
    return rows.select(
        "key", "idx", "v", "votes", "kind", F.col("low").alias("expected_min"), F.col("high").alias("expected_max"),
        "confidence", "severity", severity_label(F.col("severity")).alias("level"),
    )


def most_severe(scored: DataFrame, least: float = 0.15, most: int | None = None) -> DataFrame:
    """Rows from a severity on, the most severe first; equal ones by key and time."""
    out = scored.where(F.col("severity") >= least).orderBy(F.desc("severity"), "key", "idx")
    return out.limit(most) if most else out


def summary(scored: DataFrame) -> DataFrame:
    """One pass of grouping sets: (kind, level, n, mean_severity, max_severity) by kind, by level and overall."""
    rows = scored.groupingSets([["kind"], ["level"], []], "kind", "level")
    return rows.agg(
        F.count("*").alias("n"), F.round(F.avg("severity"), 4).alias("mean_severity"), F.max("severity").alias("max_severity")
    )


def detection_summary(scored: DataFrame) -> DataFrame:
    """One row: total, means, how many keys are affected and which, counts by kind and by level ('drop:2,spike:5')."""

    sets = scored.groupingSets([["kind"], ["level"], ["key"], []], "kind", "level", "key").agg(
        F.count("*").alias("n"), F.avg("severity").alias("s"), F.avg("confidence").alias("c"), F.grouping_id("kind", "level", "key").alias("gid")
    )
    by_kind, by_level, by_key, whole = (F.col("gid") == x for x in (3, 5, 6, 7))  # a bit for each column that a set leaves out

    def listed(which: Column, *parts: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(which, F.concat(*parts)))), ",")

    n = F.concat(F.lit(":"), F.col("n").cast("string"))
    return sets.agg(
        F.max(F.when(whole, F.col("n"))).alias("total"),
        F.round(F.max(F.when(whole, F.col("s"))), 4).alias("mean_severity"),
        F.round(F.max(F.when(whole, F.col("c"))), 4).alias("mean_confidence"),
        F.count_if(by_key).alias("keys"),
        listed(by_key, F.col("key")).alias("affected"),
        listed(by_kind, F.col("kind"), n).alias("by_kind"),
        listed(by_level, F.col("level"), n).alias("by_level"),
    )


def dashboard(scored: DataFrame) -> DataFrame:
    """One row of counts by severity (.8 and .5) and kind; an unknown kind counts as a spike."""
    s, known = F.col("severity"), F.col("kind").isin("drop", "collective")
    return scored.agg(
        F.count_if(s >= 0.8).alias("critical"),
        F.count_if((s >= 0.5) & (s < 0.8)).alias("warning"),
        F.count_if(s < 0.5).alias("info"),
        F.count_if(F.col("kind") == "drop").alias("drops"),
        F.count_if(F.col("kind") == "collective").alias("collective"),
        F.count_if(~known).alias("spikes"),
    )
