"""Root causes of an anomaly: segments, attribution, correlations, interactions, confidence, hypothesis.

Panels are DataFrames (t, dimensions..., v): several rows a time. Anomalies are
a DataFrame (anomaly_id, t, ...); everything is worked out for all anomalies at
once, joined by id, never in a loop.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.math import clamp01, student_p_value
from ..sources.sinks import settle

BASELINE_TIMES = 7
MIN_SEGMENT = 10


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], how: str = "backward", part: str = "day") -> DataFrame:
    """left with values of right's row nearest in time, of the same key: the last not after it, or the closest either way.

    Of two equally close rows the earlier is taken; several right rows of one
    time count as their last in the order of values. A union and windows, no
    join of all pairs of times: rows meet within their key and part of time, and
    each part carries over the last right row of the parts before it (and the
    first of those after), so a hot key is no single task.
    """
    packed = F.struct(F.col(time).alias("at"), *(F.col(v) for v in values))
    both = left.withColumn("_r", F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType)).withColumn("_side", F.lit(1))
    other = right.groupBy(key, time).agg(F.max(packed).alias("_r")).withColumn("_side", F.lit(0))
    both = both.unionByName(other, allowMissingColumns=True).withColumn("_part", F.date_trunc(part, F.col(time)))
    parts = both.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    order = Window.partitionBy("_key").orderBy("_of")  # a row for each part of a key
    back = Window.partitionBy("_key").orderBy(F.desc("_of"))  # a frame up to the end would be read again for each row
    parts = parts.select(
        "_key", "_of", F.last("_last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_past"),
        F.last("_first", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_next"),
    )
    within = Window.partitionBy(key, "_part").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_b", F.last("_r", True).over(within))
    if how != "backward":
        ahead = Window.partitionBy(key, "_part").orderBy(F.desc(time), "_side").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_a", F.last("_r", True).over(ahead))
    both = both.where("_side = 1").join(parts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_part").eqNullSafe(F.col("_of")), "left")
    before = F.coalesce("_b", "_past")
    if how == "backward":
        found = both.withColumn("_m", before)
    else:
        both = both.withColumn("_b", before).withColumn("_a", F.coalesce("_a", "_next"))
        gap = lambda c: F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col(f"{c}.at").cast("timestamp")))
        closer = F.col("_b").isNull() | (F.col("_a").isNotNull() & (gap("_a") < gap("_b")))
        found = both.withColumn("_m", F.when(closer, F.col("_a")).otherwise(F.col("_b")))
    return found.select(*left.columns, *(F.col("_m")[v].alias(v) for v in values))


def seen_before(times: DataFrame) -> DataFrame:
    """(t, real) with seen: how many real times lie before t.

    Times are counted within their month and shifted by the months before, so no task sorts all of them.
    """
    rows = times.withColumn("_month", F.date_trunc("month", "t"))
    months = rows.groupBy("_month").agg(F.sum("real").alias("_n"))
    earlier = Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)  # a row a month
    starts = months.select("_month", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_month").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_seen", F.coalesce(F.sum("real").over(within), F.lit(0))).join(starts, "_month")
    return rows.select("t", "real", (F.col("_start") + F.col("_seen")).alias("seen"))


def baseline_times(panel: DataFrame, anomalies: DataFrame, n: int = BASELINE_TIMES) -> DataFrame:
    """(anomaly_id, t): the last n distinct times of the panel before each anomaly, looked up by their number."""
    times = panel.select("t").distinct().withColumn("real", F.lit(1))
    times = times.unionByName(anomalies.select("t").distinct().withColumn("real", F.lit(0)))
    places = seen_before(times.groupBy("t").agg(F.max("real").alias("real")))
    wanted = anomalies.select("anomaly_id", "t").join(places.select("t", "seen"), "t").where("seen > 0")
    wanted = wanted.select("anomaly_id", F.explode(F.sequence(F.greatest(F.col("seen") - n + 1, F.lit(1)), "seen")).alias("place"))
    return wanted.join(places.where("real = 1").select((F.col("seen") + 1).alias("place"), "t"), "place").select("anomaly_id", "t")


def long_dimensions(panel: DataFrame, dims: list[str]) -> DataFrame:
    """(t, dimension, segment, v): each row once for each dimension."""
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dims))
    return panel.select("t", "v", F.explode(cells).alias("x")).select("t", "x.dimension", "x.segment", "v")


def times_around(panel: DataFrame, anomalies: DataFrame, n: int = BASELINE_TIMES) -> DataFrame:
    """(anomaly_id, t, now): each anomaly's own time and its baseline, n + 1 rows at most."""
    base = baseline_times(panel, anomalies, n).withColumn("now", F.lit(False))
    return base.unionByName(anomalies.select("anomaly_id", "t", F.lit(True).alias("now")))


#: Bins of values: so many for each doubling, and how finely values far below the mean size are told apart.
BINS_PER_OCTAVE, FINEST = 64, 1024
#: Bins in which medians are looked up, up to which they are broadcast.
BROADCAST_BINS = 100_000


def segments(
    panel: DataFrame, anomalies: DataFrame, dims: list[str], least: int = MIN_SEGMENT, n: int = BASELINE_TIMES, median: bool = True
) -> DataFrame:
    """Each segment's actual sum, baseline mean, deviation, median and their ratio; at least `least` baseline rows.

    Rows are summed up once by time, segment and bin of values; anomalies put
    together the cells of their times, so the panel is not copied for each of
    them. Medians are exact: the cells' counts tell the bins that hold the
    middle ranks, and only the values in those bins are looked at again.
    """
    center, size = panel.agg(F.avg("v"), F.avg(F.abs("v"))).first()
    size = size or 1.0
    scale = F.floor(BINS_PER_OCTAVE * F.log2(1 + FINEST * F.abs("v") / size))
    rows = long_dimensions(panel, dims).withColumn("bin", (F.signum("v") * scale).cast("int"))
    off = F.col("v") - F.lit(center)
    cells = rows.groupBy("t", "dimension", "segment", "bin").agg(  # rows without a value are a bin of their own: their times count
        F.count("v").alias("n"), F.sum("v").alias("total"), F.sum(off).alias("s1"), F.sum(off * off).alias("s2")
    )
    cells = settle(cells, "segment-cells")
    keys = ["anomaly_id", "dimension", "segment"]
    anomalies = settle(anomalies.select("anomaly_id", "t"), "segment-anomalies")
    times = settle(times_around(cells, anomalies, n), "segment-times")
    around = cells.join(times, "t")
    base = lambda c: F.sum(F.when(~F.col("now"), F.col(c)))
    out = around.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("now"), F.col("total"))), F.lit(0.0)).alias("actual"), base("total").alias("_total"), base("s1").alias("_s1"),
        base("s2").alias("_s2"), base("n").alias("size"), F.coalesce(F.sum(F.when(F.col("now"), F.col("n"))), F.lit(0)).alias("now_rows"),
    ).where(F.col("size") >= least)
    spread = F.greatest(F.lit(0.0), F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("size"))
    out = out.withColumn("mean", F.col("_total") / F.col("size")).withColumn("sd", F.when(F.col("size") > 1, F.sqrt(spread / (F.col("size") - 1))))
    if median:
        ranks = out.select(*keys, F.floor((F.col("size") - 1) / 2).alias("lo"), F.ceil((F.col("size") - 1) / 2).alias("hi"))
        out = out.join(_medians(rows, around.where(~F.col("now")), ranks, times.where(~F.col("now"))), keys, "left")
    out = out.withColumn("expected", F.col("mean") * F.col("now_rows"))
    out = out.withColumn("deviation", F.col("actual") - F.col("expected")).withColumn(
        "ratio", F.when(F.col("expected") != 0, F.col("actual") / F.col("expected"))
    )
    return out.select(*keys, "actual", "mean", "sd", *(["median"] if median else []), "size", "now_rows", "expected", "deviation", "ratio")


def _medians(rows: DataFrame, cells: DataFrame, ranks: DataFrame, times: DataFrame) -> DataFrame:
    """(anomaly_id, dimension, segment, median) from rows (t, dimension, segment, bin, v) and their counts by anomaly and bin."""
    keys = ["anomaly_id", "dimension", "segment"]
    in_order = Window.partitionBy(*keys)
    upto = lambda c: in_order.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    bins = cells.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).withColumn("end", F.sum("n").over(upto("bin")))
    bins = bins.join(ranks, keys).where((F.col("end") > F.col("lo")) & (F.col("end") - F.col("n") <= F.col("hi")))
    bins = bins.withColumn("start", F.min(F.col("end") - F.col("n")).over(in_order)).select(*keys, "bin", "start", "lo", "hi")
    wanted = settle(bins.join(times.select("anomaly_id", "t"), "anomaly_id"), "segment-bins")
    places = wanted.select("t", "dimension", "segment", "bin").distinct()
    few = places.count() <= BROADCAST_BINS
    met = rows.join(F.broadcast(places) if few else places, ["t", "dimension", "segment", "bin"], "left_semi")
    counted = met.groupBy("t", "dimension", "segment", "bin", "v").agg(F.count("*").alias("n"))
    values = counted.join(wanted, ["t", "dimension", "segment", "bin"])
    values = values.groupBy(*keys, "v", "start", "lo", "hi").agg(F.sum("n").alias("n")).withColumn("end", F.col("start") + F.sum("n").over(upto("v")))
    at = lambda rank: F.max(F.when((F.col("end") > F.col(rank)) & (F.col("end") - F.col("n") <= F.col(rank)), F.col("v")))
    return values.groupBy(*keys).agg(((at("lo") + at("hi")) / 2).alias("median"))


def contributions(seg: DataFrame) -> DataFrame:
    """seg with contribution: its share of all absolute deviations of the anomaly and dimension, in percent."""
    total = F.sum(F.abs("deviation")).over(Window.partitionBy("anomaly_id", "dimension"))
    return seg.withColumn("contribution", F.when(total > 0, 100 * F.abs("deviation") / total).otherwise(0.0))


def top_segments(seg: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("anomaly_id").orderBy(F.desc(F.round(F.abs("deviation"), 4)), "dimension", "segment")
    return seg.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def segment_significance(seg: DataFrame) -> DataFrame:
    """seg with t of the anomaly's mean against the baseline and its p; without spread p is 0 or 1."""
    now_mean = F.try_divide(F.col("actual"), F.col("now_rows"))
    t = (now_mean - F.col("mean")) / (F.col("sd") / F.sqrt("size"))
    out = seg.withColumn("t_stat", F.when((F.col("sd") > 0) & (F.col("now_rows") > 0), t))
    p = student_p_value(F.col("t_stat"), (F.col("size") - 1).cast("double"))
    return out.withColumn("p", F.coalesce(p, F.when(now_mean == F.col("mean"), 1.0).otherwise(0.0)))


def attribution(seg: DataFrame, least: float = 1.0) -> DataFrame:
    """Drivers: deviation as a signed percentage of all absolute deviations of the dimension; under `least` left out, the rest scaled to 100."""
    w = Window.partitionBy("anomaly_id", "dimension")
    out = seg.withColumn("pct", F.try_divide(100 * F.col("deviation"), F.sum(F.abs("deviation")).over(w)))
    out = out.where(F.abs(F.round("pct", 6)) >= least)
    return out.withColumn("share", 100 * F.abs("pct") / F.sum(F.abs("pct")).over(w))


def interactions(rows: DataFrame, d1: str, d2: str) -> DataFrame:
    """Pair cells: value, mean of the two margins, their difference and whether it is synergistic."""
    cell = rows.groupBy(d1, d2).agg(F.avg("v").alias("value"))
    a, b = rows.groupBy(d1).agg(F.avg("v").alias("b1")), rows.groupBy(d2).agg(F.avg("v").alias("b2"))
    out = cell.join(a, d1).join(b, d2)
    effect = F.col("value") - (F.col("b1") + F.col("b2")) / 2
    kind = F.when(F.round(effect, 6) > 0, "synergistic").otherwise("diminishing")
    return out.select(F.col(d1).alias("x"), F.col(d2).alias("y"), F.lit(f"{d1}*{d2}").alias("pair"), "value", effect.alias("effect"), kind.alias("kind"))


def all_interactions(rows: DataFrame, dims: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (interactions(rows, a, b) for a, b in combinations(dims, 2)))


def impact_cells(panel: DataFrame, anomalies: DataFrame, dims: list[str], n: int = BASELINE_TIMES) -> DataFrame:
    """(anomaly_id, now, dims, total, n): each anomaly's sums by combination of segments, from one aggregation of the panel by time."""
    cells = settle(panel.groupBy("t", *dims).agg(F.sum("v").alias("total"), F.count("v").alias("n")), "impact-cells")
    anomalies = settle(anomalies.select("anomaly_id", "t"), "impact-anomalies")
    around = cells.where("n > 0").join(times_around(cells, anomalies, n), "t")
    around = around.groupBy("anomaly_id", "now", *dims).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return settle(around, "impact-cells-around")


def impacts(cells: DataFrame) -> DataFrame:
    """(anomaly_id, impact): the sum at the anomaly's time less what as many baseline rows come to."""
    part = lambda c, now: F.coalesce(F.sum(F.when(F.col("now") == now, F.col(c))), F.lit(0.0))
    expected = part("n", True) * F.try_divide(part("total", False), part("n", False))
    return cells.groupBy("anomaly_id").agg((part("total", True) - F.coalesce(expected, F.lit(0.0))).alias("impact"))


#: Dimensions up to which Shapley values are exact; beyond, so many seeded orders of the dimensions are averaged.
EXACT_DIMS, ORDERS = 5, 64


def shapley_steps(dims: list[str], exact: int = EXACT_DIMS, orders: int = ORDERS, seed: int = 7) -> list[tuple[frozenset, str, float]]:
    """(coalition, dimension that joins it, weight): all of them, or those met in sampled orders; weights of a dimension add up to 1.

    Each sampled order is used backwards, too, which cancels part of the error.
    """
    n = len(dims)
    if n <= exact:
        return [
            (frozenset(c), d, factorial(k) * factorial(n - k - 1) / factorial(n))
            for d in dims for k in range(n) for c in combinations([x for x in dims if x != d], k)
        ]
    rng, steps = np.random.default_rng(seed), {}
    drawn = [list(rng.permutation(n)) for _ in range((orders + 1) // 2)]
    drawn += [o[::-1] for o in drawn]
    for order in drawn:
        for k, i in enumerate(order):
            step = (frozenset(dims[j] for j in order[:k]), dims[i])
            steps[step] = steps.get(step, 0.0) + 1 / len(drawn)
    return [(c, d, w) for (c, d), w in steps.items()]


def shapley_of_cells(cells: DataFrame, dims: list[str], exact: int = EXACT_DIMS, orders: int = ORDERS, seed: int = 7) -> DataFrame:
    """(anomaly_id, dimension, value, percent): Shapley values of the dimensions for every anomaly, and as shares of its impact.

    A coalition's value is the sum over the anomaly's rows of the baseline mean
    of their segment in the coalition's dimensions, against the overall mean
    where it has no baseline. All coalitions needed are grouping sets of one
    aggregation over all anomalies' cells (impact_cells). The values are scaled
    to the anomaly's impact, of which percent is the share; without an impact
    it is 0, and where the values cancel out they stay as they are.
    """
    n = len(dims)
    steps = shapley_steps(dims, exact, orders, seed)
    subsets = sorted({c for c, _, _ in steps} | {c | {d} for c, d, _ in steps} | {frozenset()}, key=lambda c: (len(c), sorted(c)))
    # grouping_id has a bit for each dimension that a set leaves out, the last dimension's the lowest
    number = {c: sum(2 ** (n - 1 - i) for i, d in enumerate(dims) if d not in c) for c in subsets}
    kept = [F.col("anomaly_id"), *(F.col(d) for d in dims)]
    base, now = ~F.col("now"), F.col("now")
    sets = cells.groupingSets([["anomaly_id", *(d for d in dims if d in c)] for c in subsets], *kept).agg(
        F.try_divide(F.sum(F.when(base, F.col("total"))), F.sum(F.when(base, F.col("n")))).alias("mean"),
        F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).alias("n"), F.grouping_id(*kept).cast("int").alias("gid"),
    )
    # rows without a baseline take the overall mean, which is the empty coalition's
    worth = sets.groupBy("anomaly_id", "gid").agg(
        F.coalesce(F.sum(F.col("n") * F.col("mean")), F.lit(0.0)).alias("known"), F.coalesce(F.sum(F.when(F.col("mean").isNull(), F.col("n"))), F.lit(0)).alias("unknown"),
        F.max(F.when(F.col("gid") == 2**n - 1, F.col("mean"))).alias("_all"),
    )
    overall = F.max("_all").over(Window.partitionBy("anomaly_id"))
    worth = settle(worth.select("anomaly_id", "gid", (F.col("known") + F.col("unknown") * F.coalesce(overall, F.lit(0.0))).alias("w")), "shapley-worth")
    rows = [(number[c], number[c | {d}], d, w) for c, d, w in steps]
    weights = F.broadcast(cells.sparkSession.createDataFrame(rows, "gid int, gid_with int, dimension string, weight double"))  # a row for each step
    with_d = worth.select("anomaly_id", F.col("gid").alias("gid_with"), F.col("w").alias("w_with"))
    gains = worth.join(weights, "gid").join(with_d, ["anomaly_id", "gid_with"])
    values = gains.groupBy("anomaly_id", "dimension").agg(F.sum(F.col("weight") * (F.col("w_with") - F.col("w"))).alias("value"))
    whole = F.sum("value").over(Window.partitionBy("anomaly_id"))
    scaled = F.when(F.abs(whole) > 1e-9, F.col("value") * F.col("impact") / whole).otherwise(F.col("value"))
    percent = F.when(F.col("impact") != 0, 100 * scaled / F.col("impact")).otherwise(0.0)
    return values.join(impacts(cells), "anomaly_id").select("anomaly_id", "dimension", "value", percent.alias("percent"))


def shapley(rows: DataFrame, dims: list[str], **options) -> DataFrame:
    """shapley_of_cells for rows (now, v, dimensions...) of one anomaly, or with an anomaly_id of several: (dimension, value, percent)."""
    one = "anomaly_id" not in rows.columns
    rows = rows.withColumn("anomaly_id", F.lit(1)) if one else rows
    cells = rows.where("v is not null").groupBy("anomaly_id", "now", *dims).agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    out = shapley_of_cells(cells, dims, **options)
    return out.drop("anomaly_id") if one else out


def anomaly_interactions(cells: DataFrame, dims: list[str], least: float = 1.0) -> DataFrame:
    """(anomaly_id, pair, x, y, value, baseline, effect, percent, kind) of impact_cells: pairs of segments at an anomaly's time.

    value is the pair's sum, baseline the mean of both segments' baseline means;
    pairs without both and effects up to `least` percent of the anomaly's impact are left out.
    """
    total = impacts(cells)
    now = cells.where("now")
    out = []
    for a, b in combinations(dims, 2):
        means = [
            cells.where(~F.col("now")).groupBy("anomaly_id", F.col(d).alias(k)).agg((F.sum("total") / F.sum("n")).alias(f"_{k}"))
            for d, k in ((a, "x"), (b, "y"))
        ]
        pair = now.groupBy("anomaly_id", F.col(a).alias("x"), F.col(b).alias("y")).agg(F.sum("total").alias("value"))
        pair = pair.join(means[0], ["anomaly_id", "x"]).join(means[1], ["anomaly_id", "y"])
        out.append(pair.select("anomaly_id", F.lit(f"{a} x {b}").alias("pair"), F.col("x").cast("string").alias("x"), F.col("y").cast("string").alias("y"), "value", ((F.col("_x") + F.col("_y")) / 2).alias("baseline")))
    rows = reduce(DataFrame.unionByName, out).withColumn("effect", F.col("value") - F.col("baseline")).join(total, "anomaly_id")
    rows = rows.where(F.abs("effect") > F.abs("impact") * least / 100)
    percent = F.when(F.col("impact") != 0, 100 * F.col("effect") / F.col("impact")).otherwise(0.0)
    kind = F.when(F.col("effect") > 0, "synergistic").otherwise("diminishing")
    return rows.select("anomaly_id", "pair", "x", "y", "value", "baseline", "effect", percent.alias("percent"), kind.alias("kind"))


def bootstrap_ratios(rows: DataFrame, rounds: int = 1000, level: float = 0.95) -> DataFrame:
    """(anomaly_id, dimension, segment, low, high): percentile interval of a segment's resampled impact over its own.

    rows: row_id, anomaly_id, dimension, segment, now, v. The impact is the sum of
    the anomaly's rows less what as many rows of the baseline mean. Poisson
    bootstrap: in each round a row weighs a number drawn by hash of row and
    round. Tasks add up all rounds of a segment as arrays before the shuffle.
    """
    keys = ["anomaly_id", "dimension", "segment"]
    part = F.when(F.col("now"), "now").otherwise("base")
    sums = _resampled(rows.withColumn("_part", part), [*keys, "_part"], rounds)
    both = [F.sum(F.when(F.col("_part") == p, F.col(c))).alias(f"{p}_{c}") for p in ("now", "base") for c in ("total", "n")]
    return _intervals(sums.groupBy(*keys, "round").agg(*both), level)


def bootstrap_all(panel: DataFrame, anomalies: DataFrame, dims: list[str], rounds: int = 1000, level: float = 0.95, n: int = BASELINE_TIMES) -> DataFrame:
    """bootstrap_ratios for all anomalies of a panel (row_id, t, dims, v).

    Rows are resampled once, whatever the number of anomalies and dimensions; an
    anomaly adds up the rounds of its times.
    """
    rows = panel.select("row_id", "t", "v", *(F.col(d).cast("string").alias(d) for d in dims))
    sums = settle(_resampled(rows, ["t"], rounds, dims), "bootstrap-cells")
    around = sums.join(times_around(panel, anomalies, n), "t")
    both = [F.sum(F.when(F.col("now") == now, F.col(c))).alias(f"{p}_{c}") for p, now in (("now", True), ("base", False)) for c in ("total", "n")]
    return _intervals(around.groupBy("anomaly_id", "dimension", "segment", "round").agg(*both), level)


#: Rows whose rounds are drawn at a time; cells whose sums a task holds (16 kB each at 1,000 rounds) before it passes them on.
DRAWN_ROWS, HELD_CELLS = 64, 4096
#: Bits of a draw that nearly always tell the weight.
TOP_BITS = 12


class Draws:
    """Weights of rows in each round, a Poisson number by hash of row and round; 1 in round 0, which is no resampling."""

    def __init__(self, rounds: int):
        self.steps = np.arange(rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.limits = np.cumsum([exp(-1) / factorial(k) for k in range(9)])
        starts = np.arange(2**TOP_BITS, dtype=np.uint64) << np.uint64(53 - TOP_BITS)
        low, high = (self._weigh(x) for x in (starts, starts + np.uint64(2 ** (53 - TOP_BITS) - 1)))
        self.table = np.where(low == high, low, -1).astype(float)
        self.x, self.y = (np.empty((DRAWN_ROWS, rounds + 1), np.uint64) for _ in range(2))
        self.w = np.empty((DRAWN_ROWS, rounds + 1))

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.limits, x / 2.0**53, side="right")

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """A row for each of up to DRAWN_ROWS hashes; the next call overwrites it."""
        x, y, w = (a[: len(hashes)] for a in (self.x, self.y, self.w))
        np.add(hashes[:, None], self.steps, out=x)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(x, np.uint64(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint64(factor), out=x)
        np.right_shift(x, np.uint64(31), out=y)
        np.bitwise_xor(x, y, out=x)
        np.right_shift(x, np.uint64(64 - TOP_BITS), out=y)
        self.table.take(y.view(np.int64), out=w, mode="clip")
        unsure = w < 0
        w[unsure] = self._weigh(x[unsure] >> np.uint64(11))
        w[:, 0] = 1.0
        return w


def _numbered(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Each row's number among the batch's distinct keys, and those."""
    codes = np.zeros(len(batch), np.int64)
    for k in keys:
        column = batch.column(k).dictionary_encode()
        own = column.indices.fill_null(len(column.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.unique(codes * (len(column.dictionary) + 1) + own, return_inverse=True)[1]
    first = np.unique(codes, return_index=True)[1]
    return codes, list(zip(*(batch.column(k).take(pa.array(first)).to_pylist() for k in keys), strict=True))


def _resampled(rows: DataFrame, keys: list[str], rounds: int, dims: list[str] | None = None) -> DataFrame:
    """(keys, round, total, n): weighted sums of v and weights in each round; round 0 is the rows as they are.

    With dims, these are summed up by (keys, dimension, segment). A row's
    weights are drawn once: a task adds up rows by keys and all dims, and those sums by dimension.
    """

    def cells(key: tuple) -> list[tuple]:
        if dims is None:
            return [key]
        return [(*key[: len(keys)], d, s) for d, s in zip(dims, key[len(keys) :], strict=True)]

    def passed_on(held: dict):
        for key, sums in held.items():
            columns = [pa.repeat(pa.scalar(k, t), rounds + 1) for k, t in zip(key, types, strict=True)]
            columns += [pa.array(np.arange(rounds + 1, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "round", "total", "n"])
        held.clear()

    def rolled_up(fine: dict, coarse: dict):
        for key, sums in fine.items():
            for cell in cells(key):
                if cell in coarse:
                    coarse[cell] += sums
                else:
                    coarse[cell] = sums.copy()
                    if len(coarse) > HELD_CELLS:
                        yield from passed_on(coarse)
        fine.clear()

    def add_up(batches):
        draws, fine, coarse = Draws(rounds), {}, {}
        for batch in batches:
            if not len(batch):
                continue
            h, v = batch.column("_h").to_numpy().astype(np.uint64), batch.column("v").to_numpy()
            codes, found = _numbered(batch, [*keys, *(dims or [])])
            order = np.argsort(codes, kind="stable")
            for s in range(0, len(order), DRAWN_ROWS):
                at = order[s : s + DRAWN_ROWS]
                w, factors = draws.weights(h[at]), np.stack([v[at], np.ones(len(at))])
                cuts = [0, *(np.nonzero(np.diff(codes[at]))[0] + 1), len(at)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    sums, key = factors[:, x:y] @ w[x:y], found[codes[at[x]]]
                    if key in fine:
                        fine[key] += sums
                    else:
                        fine[key] = sums
                        if len(fine) > HELD_CELLS:
                            yield from rolled_up(fine, coarse)
        yield from rolled_up(fine, coarse)
        yield from passed_on(coarse)

    known = rows.where("v is not null").select(F.xxhash64("row_id").alias("_h"), *keys, *(dims or []), F.col("v").cast("double").alias("v"))
    by_dim = [] if dims is None else ["dimension", "segment"]
    names = [*keys, *by_dim]
    types = [*(to_arrow_type(known.schema[k].dataType) for k in keys), *(pa.string() for _ in by_dim)]
    ddl = ", ".join([*(f"{k} {known.schema[k].dataType.simpleString()}" for k in keys), *(f"{k} string" for k in by_dim)]) + ", round int, total double, n double"
    return known.mapInArrow(add_up, ddl).groupBy(*names, "round").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _intervals(sums: DataFrame, level: float) -> DataFrame:
    keys = ["anomaly_id", "dimension", "segment"]
    impact = F.col("now_total") - F.col("now_n") * F.try_divide(F.col("base_total"), F.col("base_n"))
    own = F.max(F.when(F.col("round") == 0, impact)).over(Window.partitionBy(*keys))
    ratios = sums.withColumn("impact", impact).withColumn("own", own).where("round > 0 and impact is not null and own <> 0")
    q = F.percentile(F.col("impact") / F.col("own"), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return ratios.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


# --- correlations: wide is (idx, metric columns...) ----------------------------------------------------------


def correlations(wide: DataFrame, metrics: list[str], how: str = "pearson") -> DataFrame:
    """(a, b, n, r) for all pairs of metrics in one aggregation; spearman ranks each column first, ties at their mean."""
    if how == "spearman":
        for m in metrics:
            wide = with_rank(wide, m)
    pairs = list(combinations(metrics, 2))
    both = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    facts = [F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)] + [F.count_if(x).alias(f"n{i}") for i, x in enumerate(both)]
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return wide.agg(*facts).select(F.inline(rows))


def with_rank(wide: DataFrame, m: str, parts: int = 64) -> DataFrame:
    """wide with column m as its rank, ties at their mean, nulls null.

    Rows are counted by distinct value; values are ranked within parts cut at
    approximate quantiles and shifted by the parts before, so no task sorts all rows.
    """
    cuts = sorted(set(wide.approxQuantile(m, [i / parts for i in range(1, parts)], 0.01)))
    part = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(m)))
    values = wide.where(F.col(m).isNotNull()).groupBy(m).agg(F.count("*").alias("_n")).withColumn("_part", part)
    sizes = values.groupBy("_part").agg(F.sum("_n").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(m).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(starts, "_part")
    ranks = values.select(m, (F.col("_start") + F.col("_before") + (F.col("_n") + 1) / 2).alias("_rank"))
    return wide.join(ranks, m, "left").withColumn(m, F.col("_rank")).drop("_rank")


def correlation_significance(c: DataFrame) -> DataFrame:
    """c with t and p of r."""
    df = F.col("n") - 2
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt(df / (1 - F.col("r") * F.col("r"))))
    out = c.withColumn("t_stat", t)
    return out.withColumn("p", F.coalesce(student_p_value(F.col("t_stat"), df.cast("double")), F.lit(0.0)))


def adjust(c: DataFrame, p: str = "p") -> DataFrame:
    """c with bonferroni and Benjamini-Hochberg q (the running minimum from the largest p); c is one row a test."""
    everything = Window.partitionBy()
    n = F.count("*").over(everything)
    r = F.row_number().over(Window.orderBy(p, "a", "b"))
    out = c.withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * n)).withColumn("_q", F.col(p) * n / r)
    down = Window.orderBy(F.desc(p), F.desc("a"), F.desc("b"))
    return out.withColumn("bh", F.least(F.lit(1.0), F.min("_q").over(down))).drop("_q")


def lagged(wide: DataFrame, a: str, b: str, most: int = 24) -> DataFrame:
    """(lag, c): standardised a at idx times b at idx + lag, summed and divided by n; a positive lag means a leads."""
    stats = wide.agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.count("*").alias("_n")
    )
    z = wide.crossJoin(F.broadcast(stats)).select(
        "idx", "_n", F.try_divide(F.col(a) - F.col("ma"), "sa").alias("x"), F.try_divide(F.col(b) - F.col("mb"), "sb").alias("y")
    )
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")
    left = z.select("_n", "x", "idx", lags).withColumn("at", F.col("idx") + F.col("lag"))
    left = left.where(F.abs("lag") <= F.floor(F.col("_n") / 4))
    right = z.select(F.col("idx").alias("at"), "y")
    return left.join(right, "at").groupBy("lag").agg((F.sum(F.col("x") * F.col("y")) / F.first("_n")).alias("c"))


def best_lag(lags: DataFrame) -> DataFrame:
    """One row: lag of the greatest |c| (ties to the smallest |lag|, then the earlier), c, direction."""
    top = F.max_by(F.struct("lag", "c"), F.struct(F.round(F.abs("c"), 9), -F.abs("lag"), -F.col("lag"))).alias("b")
    kind = F.when(F.col("b.lag") > 0, "leads").when(F.col("b.lag") < 0, "lags").otherwise("together")
    return lags.agg(top).select("b.lag", F.col("b.c").alias("c"), kind.alias("direction"))


def most_variable(wide: DataFrame, metrics: list[str], most: int) -> DataFrame:
    """(metric, variance) of the metrics that vary most."""
    one = wide.agg(*(F.var_samp(m).alias(m) for m in metrics))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("variance")) for m in metrics))
    return one.select(F.inline(rows)).orderBy(F.desc("variance"), "metric").limit(most)


def window_before(wide: DataFrame, at: int, before: int = 84, total: int = 168) -> DataFrame:
    """Rows by idx around a point: `before` ahead of it, `total` in all."""
    return wide.where((F.col("idx") >= at - before) & (F.col("idx") < at - before + total))


def change_magnitude(s: DataFrame, points: DataFrame) -> DataFrame:
    """(key, before, after, magnitude): means before and after each key's change point, difference in population deviations."""
    rows = s.join(points.select("key", F.col("idx").alias("at")), "key")
    early = F.col("idx") <= F.col("at")
    out = rows.groupBy("key").agg(
        F.avg(F.when(early, F.col("v"))).alias("before"), F.avg(F.when(~early, F.col("v"))).alias("after"), F.stddev_pop("v").alias("sd")
    )
    return out.select("key", "before", "after", F.when(F.col("sd") > 0, (F.col("after") - F.col("before")) / F.col("sd")).alias("magnitude"))


# --- insight -------------------------------------------------------------------------------------------------


def expected_value(s: DataFrame) -> DataFrame:
    """(key, expected): mean of the last min(7, n / 2) points; fewer than 3 points give null."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("idx")))
    n = F.count("*").over(Window.partitionBy("key"))
    rows = s.withColumn("_r", newest).withColumn("_n", n).where(F.col("_r") <= F.least(F.lit(7), F.floor(F.col("_n") / 2)))
    return rows.groupBy("key").agg(F.when(F.max("_n") >= 3, F.avg("v")).alias("expected"))


def change_window(s: DataFrame, anomalies: DataFrame, rows: int = 60) -> DataFrame:
    """(key, t, idx, v): for each anomaly, as key, the last rows + 1 points of its series up to its time.

    s: t, v with one point a time; anomalies: anomaly_id, t.
    """
    times = baseline_times(s, anomalies, rows).unionByName(anomalies.select("anomaly_id", "t"))
    points = times.join(s.select("t", "v"), "t").where("v is not null")
    order = Window.partitionBy("anomaly_id").orderBy("t")
    return points.select(F.col("anomaly_id").alias("key"), "t", (F.row_number().over(order) - 1).alias("idx"), "v")


def changes(window: DataFrame, points: DataFrame, anomalies: DataFrame, significance: float = 0.05) -> DataFrame:
    """(anomaly_id, changed_at, confidence, magnitude, days): significant change points in the first 80 % of a window.

    window is change_window's, points its change points (key, idx, p). days
    counts from the change to the anomaly, so it is never negative.
    """
    n = window.groupBy("key").agg(F.count("*").alias("n"))
    found = points.where(F.col("p") < significance).join(n, "key").where(F.col("idx") + 1 < 0.8 * F.col("n"))
    at = found.select("key", (F.col("idx") + 1).alias("idx"), "p").join(window.select("key", "idx", F.col("t").alias("changed_at")), ["key", "idx"])
    size = change_magnitude(window, found.select("key", "idx")).select("key", "magnitude")
    out = at.join(size, "key").withColumnRenamed("key", "anomaly_id").join(anomalies.select("anomaly_id", "t"), "anomaly_id")
    days = F.datediff("t", "changed_at")
    return out.select("anomaly_id", "changed_at", (1 - F.col("p")).alias("confidence"), "magnitude", days.alias("days"))


def _evidence(anomalies: DataFrame, seg: DataFrame, drivers: DataFrame, related: DataFrame, change: DataFrame) -> DataFrame:
    """One row an anomaly with what each method found, null where it found nothing."""
    order = F.struct(-F.round(F.abs("deviation"), 4), "dimension", "segment", "ratio", "contribution", "p")
    segs = seg.groupBy("anomaly_id").agg(
        F.array_sort(F.collect_list(order))[0].alias("seg"), F.count("*").alias("n_seg"),
        F.count_if(F.col("p") < 0.05).alias("n_sure"), F.avg("contribution").alias("mean_contribution"),
    )
    order = F.struct(-F.round(F.col("share"), 2), "dimension", "segment", F.round("pct", 2).alias("pct"), F.round("share", 2).alias("share"))
    by = drivers.groupBy("anomaly_id").agg(F.array_sort(F.collect_list(order)).alias("d"))
    strength = F.struct(-F.round(F.abs("r"), 6), "other", "r", "p")
    rel = related.groupBy("anomaly_id").agg(
        F.array_sort(F.collect_list(strength))[0].alias("rel"), F.count("*").alias("n_rel"), F.count_if(F.col("p") < 0.05).alias("n_rel_sure")
    )
    change = change.select("anomaly_id", F.struct("confidence", "magnitude", "days").alias("change"))
    out = anomalies
    for part in (segs, by, rel, change):
        out = out.join(part, "anomaly_id", "left")
    return out


def insights(anomalies: DataFrame, seg: DataFrame, drivers: DataFrame, related: DataFrame, change: DataFrame, most: int = 10) -> DataFrame:
    """One row an anomaly: impact, its drivers (array, largest first), confidence and hypothesis.

    anomalies: anomaly_id, metric, value, low, high; the impact is the value's
    distance from the middle of the expected range. seg: segments with
    contribution and p; related: anomaly_id, other metric, r, p; change: see
    changes. Confidence weighs the top segment's significance, the strongest
    correlation, the change point, the top driver's share and how many of the
    four methods found something.
    """
    out = _evidence(anomalies, seg, drivers, related, change)
    first = F.try_element_at("d", F.lit(1))
    impact = F.col("value") - (F.col("low") + F.col("high")) / 2
    sure, share = F.col("change.confidence"), F.abs(first["pct"])
    methods = [F.col("seg").isNotNull(), F.col("rel").isNotNull(), F.col("change").isNotNull(), first.isNotNull()]
    scores = [
        (0.25, F.when(F.col("seg.p") < 0.05, 1.0).when(F.col("seg").isNotNull(), 0.3).otherwise(0.1)),
        (0.20, F.coalesce(F.abs("rel.r"), F.lit(0.5))),
        (0.15, F.when(sure > 0.8, 1.0).when(sure > 0.6, 0.7).when(sure.isNotNull(), 0.4).otherwise(0.5)),
        (0.20, F.when(share > 40, 1.0).when(share > 20, 0.7).when(share.isNotNull(), 0.4).otherwise(0.3)),
        (0.20, reduce(lambda a, b: a + b, (m.cast("int") for m in methods)) / 4),
    ]
    conf = F.round(clamp01(reduce(lambda a, b: a + b, (w * x for w, x in scores))), 3)
    name = F.initcap(F.replace(F.col("metric"), F.lit("_"), F.lit(" ")))
    percent = lambda c: F.format_string("%.1f%%", F.round(c, 1))
    by_segment = F.concat(F.col("seg.segment"), F.lit(" ("), percent(F.col("seg.contribution")), F.lit(" contribution)."))
    story = F.concat_ws(
        " ",
        F.when(F.col("seg").isNull(), F.concat(F.lit("Anomaly detected in "), name, F.lit(".")))
        .when(F.col("seg.ratio") < 0.7, F.concat(name, F.lit(" drop primarily driven by "), by_segment))
        .when(F.col("seg.ratio") > 1.3, F.concat(name, F.lit(" spike primarily driven by "), by_segment))
        .otherwise(F.concat(F.lit("Anomaly in "), name, F.lit(" concentrated in "), by_segment)),
        F.when(
            F.col("rel.p") < 0.05,
            F.concat(F.lit("Correlated with "), F.initcap(F.replace(F.col("rel.other"), F.lit("_"), F.lit(" "))), F.lit(" (r="), F.format_string("%.2f", F.round(F.abs("rel.r"), 2)), F.lit(").")),
        ),
        F.when(sure > 0.7, F.concat(F.lit("Behavior change detected "), F.col("change.days").cast("string"), F.lit(" days before."))),
        F.concat(F.initcap(first["dimension"]), F.lit(" ("), first["segment"], F.lit(") accounts for "), percent(first["pct"]), F.lit(" of total impact.")),
    )
    return out.select(
        "anomaly_id", "metric", F.round(impact, 4).alias("impact"), F.coalesce(F.size("d"), F.lit(0)).cast("long").alias("n_drivers"),
        first["dimension"].alias("top_dimension"), first["segment"].alias("top_segment"), first["share"].alias("top_share"),
        conf.alias("confidence"), story.alias("hypothesis"), F.slice("d", 1, most).alias("drivers"),
    )


def evidence(anomalies: DataFrame, seg: DataFrame, drivers: DataFrame, related: DataFrame, change: DataFrame) -> DataFrame:
    """Counts and averages that support each anomaly's insight; arguments as for insights."""
    out = _evidence(anomalies, seg, drivers, related, change)
    return out.select(
        "anomaly_id", F.coalesce("n_seg", F.lit(0)).alias("segments"), F.coalesce("n_sure", F.lit(0)).alias("significant_segments"),
        F.round(F.coalesce("mean_contribution", F.lit(0.0)), 4).alias("mean_contribution"),
        F.coalesce("n_rel", F.lit(0)).alias("correlations"), F.round(F.abs("rel.r"), 6).alias("strongest_correlation"),
        F.coalesce("n_rel_sure", F.lit(0)).alias("significant_correlations"), F.col("change").isNotNull().alias("changed"),
        F.round("change.confidence", 4).alias("change_confidence"), F.round("change.magnitude", 4).alias("change_magnitude"),
        F.col("change.days").alias("days_since_change"), F.coalesce(F.size("d"), F.lit(0)).cast("long").alias("factors"),
        F.try_element_at("d", F.lit(1))["dimension"].alias("top_contributor"),
    )
