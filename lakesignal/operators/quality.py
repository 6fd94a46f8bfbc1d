"""Profiles and validation rules: each is one aggregation over the table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in a column name that hint at time.
TIME_WORDS = ("date", "time", "timestamp", "datetime", "created", "updated", "day", "month", "year", "start", "end")
SAMPLE_VALUES = 1000


def metric_columns(df: DataFrame, time_column: str | None = None) -> list[str]:
    """Numeric columns but the time column."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != time_column]


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text) of every cell."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(cells).alias("x")).select("x.column", "x.value")


def profile(df: DataFrame, columns: list[str], samples: int = 5) -> DataFrame:
    """(column, n, nulls, distinct, samples): the samples are the smallest distinct values, as text."""
    counts = long_values(df, columns).groupBy("column", "value").agg(F.count("*").alias("c"))
    facts = counts.groupBy("column").agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"),
    )
    # tasks pass on their least values only, no task sees all of a column's
    least = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    first = counts.where("value is not null").withColumn("r", least).where(F.col("r") <= samples)
    first = first.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples"))
    return facts.join(first, "column", "left").select("column", "n", "nulls", "distinct", F.coalesce("samples", F.lit("")).alias("samples"))


def _named_like_time(name: str) -> bool:
    return any(w in TIME_WORDS for w in name.lower().replace("-", "_").split("_"))


def infer_types(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(column, inferred): unknown, datetime, boolean, integer, float, categorical or text.

    Looks at the first SAMPLE_VALUES non-null values by `order`. A column
    named like a time whose texts parse as one in more than 70 % is datetime,
    numbers never are. Floats of at most 5 values that make less than a tenth of
    the rows, and texts of at most 10 (or less than a tenth and under 50), are categorical.
    """
    physical = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in columns if isinstance(physical[c], T.NumericType)]
    timely = [c for c in columns if _named_like_time(c) and c not in numeric]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    values = df.select(F.col(order).alias("_o"), F.explode(cells).alias("x")).select("_o", "x.column", "x.value")
    n = F.row_number().over(Window.partitionBy("column").orderBy(F.col("value").isNull(), "_o"))
    first = values.withColumn("_n", n).where(F.col("_n") <= SAMPLE_VALUES)
    v = F.col("value")
    facts = first.groupBy("column").agg(
        F.count("value").alias("n"),
        F.count_distinct("value").alias("d"),
        F.avg(F.when(v.isNotNull(), F.try_to_timestamp(v).isNotNull().cast("double"))).alias("time_share"),
        F.coalesce(F.bool_and(F.lower(v).isin("true", "false")), F.lit(False)).alias("all_bool"),
        F.coalesce(F.bool_and(v.rlike(r"^[+-]?\d+$")), F.lit(False)).alias("all_int"),
        F.coalesce(F.bool_and(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), F.lit(False)).alias("all_float"),
    )
    share = F.try_divide("d", "n")
    inferred = (
        F.when(F.col("n") == 0, "unknown")
        .when(F.col("column").isin(*timely) & (F.col("time_share") > 0.7), "datetime")
        .when(F.col("all_bool"), "boolean")
        .when(F.col("all_int"), "integer")
        .when(F.col("all_float"), F.when((share < 0.1) & (F.col("d") <= 5), "categorical").otherwise("float"))
        .when((F.col("d") <= 10) | ((share < 0.1) & (F.col("d") < 50)), "categorical")
        .otherwise("text")
    )
    return facts.select("column", inferred.alias("inferred"))


def dimensions(types: DataFrame, prof: DataFrame, low: int = 2, high: int = 50, most: int = 5) -> DataFrame:
    """(column, distinct): the first categorical or text columns, by name, with low to high distinct values."""
    rows = types.join(prof, "column").where(F.col("inferred").isin("categorical", "text") & F.col("distinct").between(low, high))
    return rows.select("column", "distinct").orderBy("column").limit(most)


def time_column(types: DataFrame, user: str | None = None) -> DataFrame:
    """(column): the user's choice if there, else the first datetime column by name."""
    mine = F.when(F.col("column") == F.lit(user), 0).when(F.col("inferred") == "datetime", 1)
    return types.withColumn("p", mine).where("p is not null").orderBy("p", "column").limit(1).select("column")


def duplicate_rows(df: DataFrame) -> Column:
    """Aggregate: rows beyond the first of their kind."""
    return F.count("*") - F.count_distinct(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256))


def quality_metrics(df: DataFrame) -> DataFrame:
    """One row: size, missing cells, repeated rows, columns with nulls, half null, constant and of low variance."""
    cols = df.columns
    numbers = set(metric_columns(df))
    facts = [F.count("*").alias("rows"), duplicate_rows(df).alias("duplicates")]
    for c in cols:
        facts += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"), F.count_distinct(c).alias(f"distinct_{c}")]
        if c in numbers:
            facts += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
    one = df.agg(*facts)
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    nulls = add(F.col(f"nulls_{c}") for c in cols)
    flat = lambda c: F.when(F.col(f"mean_{c}") == 0, F.col(f"sd_{c}") < 0.01).otherwise(
        F.col(f"sd_{c}") / F.abs(f"mean_{c}") < 0.01
    )
    return one.select(
        "rows",
        F.lit(len(cols)).alias("columns"),
        nulls.alias("missing"),
        F.round(F.try_divide(100 * nulls, F.col("rows") * len(cols)), 2).alias("missing_percent"),
        "duplicates",
        add(flag(F.col(f"nulls_{c}") > 0) for c in cols).alias("columns_with_nulls"),
        add(flag(2 * F.col(f"nulls_{c}") >= F.col("rows")) for c in cols).alias("half_null_columns"),
        add(flag(F.col(f"distinct_{c}") <= 1) for c in cols).alias("constant_columns"),
        add(flag(flat(c)) for c in cols if c in numbers).alias("low_variance_columns"),
    )


@dataclass(frozen=True)
class Rule:
    """kind: missing, duplicates, constant, min_rows, type, range, pattern or expression; value is compared with limit."""

    name: str
    kind: str
    limit: float
    severity: str = "medium"  # low, medium, high, critical
    column: str | None = None
    low: float | None = None
    high: float | None = None
    pattern: str | None = None


DEFAULT_RULES = (
    Rule("missing_values", "missing", 0.20, "high"),
    Rule("duplicate_rows", "duplicates", 0.10, "medium"),
    Rule("constant_columns", "constant", 0, "medium"),
    Rule("minimum_rows", "min_rows", 10, "high"),
)
TYPE_PATTERNS = {"integer": r"^[+-]?\d+$", "float": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "boolean": r"(?i)^(true|false|0|1|yes|no)$"}


def _share(part: Column, whole: Column) -> Column:
    """part / whole; of nothing, nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _measure(df: DataFrame, r: Rule) -> Column:
    rows, c = F.count("*"), F.col(r.column) if r.column else None
    if r.kind == "missing":
        names = [r.column] if r.column else df.columns
        return _share(sum((F.count_if(F.col(x).isNull()) for x in names), F.lit(0)), rows * len(names))
    if r.kind == "duplicates":
        return _share(duplicate_rows(df), rows)
    if r.kind == "constant":
        return sum(((F.count_distinct(x) <= 1).cast("int") for x in df.columns), F.lit(0)).cast("double")
    if r.kind == "min_rows":
        return rows.cast("double")
    if r.kind == "type":
        return _share(F.count_if(~c.cast("string").rlike(TYPE_PATTERNS[r.pattern])), F.count(c))
    if r.kind == "range":
        return _share(F.count_if(~c.between(r.low, r.high)), rows)
    if r.kind == "pattern":  # anchored at the start; null counts as the text 'nan'
        return _share(F.count_if(~F.coalesce(c.cast("string"), F.lit("nan")).rlike(f"^(?:{r.pattern})")), rows)
    return _share(F.count_if(~F.coalesce(F.expr(r.pattern), F.lit(False))), rows)


def validate(df: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """(rule, severity, value, passed), all rules from one aggregation."""
    one = df.agg(*(_measure(df, r).alias(f"m{i}") for i, r in enumerate(rules)))
    rows = F.array(
        *(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
                F.round(F.col(f"m{i}").cast("double"), 6).alias("value"),
                (F.col(f"m{i}") >= r.limit if r.kind == "min_rows" else F.col(f"m{i}") <= r.limit).alias("passed"),
            )
            for i, r in enumerate(rules)
        )
    )
    return one.select(F.inline(rows))


def overall(results: DataFrame) -> DataFrame:
    """One row: status (failed if a high or critical rule failed, else warning if any did), share passed."""
    failed = ~F.col("passed")
    return results.agg(
        F.when(F.bool_or(failed & F.col("severity").isin("high", "critical")), "failed")
        .when(F.bool_or(failed), "warning")
        .otherwise("passed")
        .alias("status"),
        F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_ratio"),
        F.bool_or(failed).alias("has_warnings"),
    )


def scores(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """One row: stored_score (missing cells as a share, what datasets keep) and pass_ratio (rules passed), of quality_metrics() and validate()."""
    stored = metrics.agg(F.round(F.first("missing_percent") / 100, 4).alias("stored_score"), F.lit(1).alias("_one"))
    ratio = overall(results).select("pass_ratio", F.lit(1).alias("_one"))
    return stored.join(ratio, "_one").drop("_one")  # two single rows


#: Digits and limits of what results report: (digits, least, greatest); None is no limit.
REPORTED = {
    "contribution": (2, 0.0, 100.0), "percent": (2, None, None), "ratio": (3, None, None), "correlation": (3, -1.0, 1.0), "p_value": (4, 0.0, 1.0),
    "confidence": (3, 0.0, 1.0), "expected_min": (4, None, None), "expected_max": (4, None, None),
}
#: Pairs of columns of which the first must not be above the second.
ORDERED = (("expected_min", "expected_max"),)


def checked(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """df with the columns of REPORTED (or those that kinds maps to them) rounded, and invalid: the names that break their limits, in order.

    Limits hold for the rounded values, nulls break none; NaN breaks every limit. A pair in the wrong order is named by both.
    """
    kinds = {c: c for c in df.columns if c in REPORTED} if kinds is None else kinds
    df = df.withColumns({c: F.round(c, REPORTED[k][0]) for c, k in kinds.items()})
    broken = []
    for c, k in kinds.items():
        _, low, high = REPORTED[k]
        for limit, beyond in ((low, lambda x, y: x < y), (high, lambda x, y: x > y)):
            if limit is not None:
                broken.append(F.when(beyond(F.col(c), F.lit(limit)) | F.isnan(c), c))
    broken += [F.when(F.col(a) > F.col(b), f"{a}, {b}") for a, b in ORDERED if {a, b} <= set(df.columns)]
    return df.withColumn("invalid", F.array_distinct(F.array_compact(F.array(*broken))) if broken else F.array().cast("array<string>"))


def report(results: DataFrame) -> DataFrame:
    """One row: rules, failed ones, passed (no high or critical rule failed), has_warnings (a medium or low one did)."""
    failed, grave = ~F.col("passed"), F.col("severity").isin("high", "critical")
    return results.agg(
        F.count("*").alias("rules"),
        F.count_if(failed).alias("failed"),
        (F.count_if(failed & grave) == 0).alias("passed"),
        (F.count_if(failed & ~grave) > 0).alias("has_warnings"),
    )


def effective_type(user: Column, inferred: Column) -> Column:
    """The user's type where there is one."""
    return F.coalesce(user, inferred)


def offenders(df: DataFrame, column: str, low: float, high: float, order: str, most: int = 5) -> DataFrame:
    """The first rows outside a range."""
    return df.where(~F.col(column).between(low, high)).select(order, column).orderBy(order).limit(most)
