"""Cleaning steps, each DataFrame to DataFrame; statistics come from one aggregation joined back as a single row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import metric_columns
from .quantiles import one_row

TIME_FEATURES = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "dayofweek": F.weekday, "dayofyear": F.dayofyear, "week": F.weekofyear, "quarter": F.quarter,
    "is_weekend": lambda c: F.weekday(c) >= 5,
}


def drop_duplicates(df: DataFrame, order: str, subset: list[str] | None = None) -> DataFrame:
    """The first row by `order` of equal rows (of subset, else of all columns but `order`)."""
    keys = subset or [c for c in df.columns if c != order]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def _one(df: DataFrame, *facts: Column):
    return df.agg(*facts).first()


def drop_constant(df: DataFrame) -> DataFrame:
    """Without columns of at most one distinct value; one pass over the table."""
    n = _one(df, *(F.count_distinct(F.col(c)).alias(c) for c in df.columns))
    return df.drop(*(c for c in df.columns if n[c] <= 1))


def drop_mostly_null(df: DataFrame, share: float = 0.8) -> DataFrame:
    n = _one(df, *(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns))
    return df.drop(*(c for c in df.columns if (n[c] or 0) >= share))


def fill_value(column: str, how: str) -> Column:
    """Aggregate that a column's nulls are filled with: mean, median, mode (the smallest of equals), zero or missing."""
    if how == "mean":
        return F.avg(column)
    if how == "median":
        return F.percentile(column, F.lit(0.5))
    if how == "mode":
        return F.mode(column, True)
    return F.lit(0.0) if how == "zero" else F.lit("missing")


def fill_missing(df: DataFrame, how: dict[str, str]) -> DataFrame:
    middle = {f"_{c}": (c, 0.5) for c, h in how.items() if h == "median"}
    others = [fill_value(c, h).alias(f"_{c}") for c, h in how.items() if h != "median"]
    out = df.crossJoin(F.broadcast(df.agg(*others))) if others else df  # one row
    out = out.crossJoin(F.broadcast(one_row(df, middle))) if middle else out  # one row
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in how}).drop(*(f"_{c}" for c in how))


def outlier_bounds(column: str) -> tuple[Column, Column]:
    """Aggregates: three population deviations (nulls counted at the median)."""
    return F.avg(column) - 3 * F.stddev_pop(column), F.avg(column) + 3 * F.stddev_pop(column)


def outliers(df: DataFrame, column: str, method: str = "iqr", treatment: str = "flag") -> DataFrame:
    """Outliers of a column flagged (column `outlier`), capped at the bounds, removed, or replaced by the median.

    Bounds are fences at 1.5 IQR, or those of outlier_bounds.
    """
    base = df
    if method == "zscore":
        mid = one_row(df, {"_m": (column, 0.5)})
        base = df.crossJoin(F.broadcast(mid)).select(F.coalesce(column, "_m").alias(column))
    stats = one_row(base, {"_a": (column, 0.25), "_b": (column, 0.75), "_mid": (column, 0.5)})
    if method == "iqr":
        spread = 1.5 * (F.col("_b") - F.col("_a"))
        stats = stats.select((F.col("_a") - spread).alias("_low"), (F.col("_b") + spread).alias("_high"), "_mid")
    else:
        low, high = outlier_bounds(column)
        stats = base.agg(low.alias("_low"), high.alias("_high")).crossJoin(F.broadcast(stats.select("_mid")))  # one row each
    out, c = df.crossJoin(F.broadcast(stats)), F.col(column)
    outside = F.coalesce((c < F.col("_low")) | (c > F.col("_high")), F.lit(False))
    if treatment == "flag":
        out = out.withColumn("outlier", outside)
    elif treatment == "cap":
        out = out.withColumn(column, F.when(c.isNotNull(), F.greatest(F.least(c, F.col("_high")), F.col("_low"))))
    elif treatment == "remove":
        out = out.where(~outside)
    else:
        out = out.withColumn(column, F.when(outside, F.col("_mid")).otherwise(c))
    return out.drop("_low", "_high", "_mid")


def normalise(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """Adds <column>_normalized: standard (sample deviation), minmax or robust (median and IQR); no spread gives 0."""
    facts = []
    for c in columns:
        if method == "standard":
            shift, scale = F.avg(c), F.stddev_samp(c)
        elif method == "minmax":
            shift, scale = F.min(c), F.max(c) - F.min(c)
        else:
            shift, scale = F.col(f"_m_{c}"), F.col(f"_h_{c}") - F.col(f"_l_{c}")
        facts += [shift.alias(f"_a_{c}"), scale.alias(f"_b_{c}")]
    if method == "robust" and columns:
        wanted = {f"_{x}_{c}": (c, q) for c in columns for x, q in (("m", 0.5), ("l", 0.25), ("h", 0.75))}
        stats = one_row(df, wanted).select(*facts)
    else:
        stats = df.agg(*facts) if facts else None
    out = df if stats is None else df.crossJoin(F.broadcast(stats))
    scaled = {f"{c}_normalized": F.when(F.col(f"_b_{c}") > 0, (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_b_{c}")).otherwise(0.0) for c in columns}
    return out.withColumns(scaled).drop(*(f"_{x}_{c}" for c in columns for x in "ab"))


def time_features(df: DataFrame, column: str, features=tuple(TIME_FEATURES)) -> DataFrame:
    """Adds <column>_<feature>; Monday is day 0."""
    return df.withColumns({f"{column}_{f}": TIME_FEATURES[f](F.col(column)) for f in features})


def category_codes(df: DataFrame, column: str, rare: float = 0.001) -> DataFrame:
    """(category, n, code): codes count the sorted categories; those below a share of rows are one, _OTHER_."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    named = counts.crossJoin(F.broadcast(total)).select(
        F.when(F.col("n") < rare * F.col("_t"), "_OTHER_").otherwise(F.col(column)).alias("category"), "n"
    )
    out = named.groupBy("category").agg(F.sum("n").alias("n"))
    return out.withColumn("code", F.row_number().over(Window.orderBy("category")) - 1)  # a row for each category


def encode(df: DataFrame, column: str, method: str = "label", rare: float = 0.001, most: int = 100) -> DataFrame:
    """Adds <column>_encoded, or a 0/1 column for each category: the first `most` by name, _OTHER_ for any others there are."""
    codes = category_codes(df, column, rare)
    if method == "label":
        known = codes.select(F.col("category").alias(column), F.col("code").alias(f"{column}_encoded"))
        other = codes.where("category = '_OTHER_'").agg(F.max("code").alias("_other"))
        known = F.broadcast(known) if rare >= 1e-4 else known  # at most 1 / rare categories and _OTHER_
        out = df.join(known, column, "left").crossJoin(F.broadcast(other))
        code = F.when(F.col(column).isNotNull(), F.coalesce(f"{column}_encoded", "_other"))
        return out.withColumn(f"{column}_encoded", code).drop("_other")
    found = [r[0] for r in codes.orderBy(F.col("category") == "_OTHER_", "category").limit(most + 1).collect()]
    names = [n for n in found if n != "_OTHER_"][:most]
    out = {f"{column}_{n}": F.coalesce((F.col(column) == n).cast("int"), F.lit(0)) for n in names}
    if len(found) > len(names):
        out[f"{column}__OTHER_"] = (F.col(column).isNotNull() & ~F.col(column).isin(*names)).cast("int")
    return df.withColumns(out)


def clean(df: DataFrame, order: str, time_column: str | None = None, scale: str = "standard") -> DataFrame:
    """All steps: repeated rows, constant and mostly null columns, fills (median or mode), time features, scaling."""
    out = drop_mostly_null(drop_constant(drop_duplicates(df, order)))
    numbers = [c for c in metric_columns(out) if c != order]
    texts = [f.name for f in out.schema if isinstance(f.dataType, T.StringType)]
    out = fill_missing(out, {c: "median" for c in numbers} | {c: "mode" for c in texts})
    if time_column in out.columns:
        out = time_features(out, time_column, ("year", "month", "dayofweek", "is_weekend"))
    return normalise(out, numbers, scale)
