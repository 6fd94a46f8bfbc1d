"""Exact percentiles of columns without a task that holds a column's values.

Values are counted first. Approximate percentiles cut each column into ranges of
about equal numbers of rows; the ranges that hold a wanted place are known from
their sums, and only those are put in order, each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a column is cut into.
RANGES = 64


def percentiles(df: DataFrame, columns: list[str], at: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(by, column, n, distinct, at): the percentiles of each numeric column as F.percentile gives them, nulls left out.

    n counts values, distinct different ones. Parts with a null in `by` and columns without a value give no row.
    """
    keys = [*(by or []), "column"]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    rows = df.select(*(by or []), F.inline(cells)).where("value is not null")
    cuts = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile_approx("value", [(i + 1) / RANGES for i in range(RANGES - 1)], 10_000).alias("_cuts")
    )
    cuts = F.broadcast(cuts)  # a row a part and column
    counted = rows.groupBy(*keys, "value").agg(F.count("*").alias("_c"))
    placed = counted.join(cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("value")))).drop("_cuts")
    sums = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"), F.count("*").alias("_d"), F.max("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    whole = Window.partitionBy(*keys)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(upto), F.lit(0))).withColumn("distinct", F.sum("_d").over(whole))
    place = [(F.col("n") - 1) * F.lit(float(q)) for q in at]
    ends = [e(p).cast("long") for p in place for e in (F.floor, F.ceil)]
    wanted = F.exists(F.array(*ends), lambda t: (t >= F.col("_before")) & (t < F.col("_before") + F.col("_s")))
    some = placed.drop("n").join(F.broadcast(sums.where(wanted).drop("_s", "_d")), [*keys, "_b"])
    inside = Window.partitionBy(*keys, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("_last", F.col("_before") + F.sum("_c").over(inside))
    found = [F.max(F.when((t < F.col("_last")) & (t >= F.col("_last") - F.col("_c")), F.col("value"))).alias(f"_x{i}") for i, t in enumerate(ends)]
    got = some.groupBy(*keys, "n", "distinct").agg(*found)
    values = []
    for i, p in enumerate(place):
        low, high = F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}")
        values.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    return got.select(*keys, "n", "distinct", F.array(*values).alias("at"))


def one_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """A single row: for each name the percentile (column, share), null for columns without a value."""
    shares = tuple(sorted({q for _, q in wanted.values()}))
    got = percentiles(df, sorted({c for c, _ in wanted.values()}), shares)
    return got.agg(*(F.max(F.when(F.col("column") == c, F.col("at")[shares.index(q)])).alias(name) for name, (c, q) in wanted.items()))
