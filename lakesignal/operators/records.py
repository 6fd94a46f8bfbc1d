"""Relational metadata: joins of datasets, anomalies and their findings, listings, deletion, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_findings(anomalies: DataFrame, causes: DataFrame, explanations: DataFrame) -> DataFrame:
    """Each anomaly with its cause and explanation, nulls where there is none."""
    return anomalies.join(causes, "anomaly_id", "left").join(explanations, "anomaly_id", "left")


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """parents with the number of their children; one aggregation, no query a row."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def delete_cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str]], root: str, key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """tables without the rows of root in gone (key) and all that hang on them.

    links: (parent, child, column), parents first; a child's rows go if their parent's did.
    """
    dropped = {root: tables[root].join(gone, key, "left_semi")}
    out = dict(tables) | {root: tables[root].join(gone, key, "left_anti")}
    for parent, child, column in links:
        if parent in dropped:
            keys = dropped[parent].select(column).distinct()
            dropped[child] = tables[child].join(keys, column, "left_semi")
            out[child] = tables[child].join(keys, column, "left_anti")
    return out


def filter_anomalies(rows: DataFrame, least: float | None = None, kind: str | None = None, metric: str | None = None) -> DataFrame:
    if least is not None:
        rows = rows.where(F.col("severity") >= least)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    return rows.where(F.col("metric") == metric) if metric is not None else rows


def search_rows(rows: DataFrame, columns: list[str], text: str, least: float) -> DataFrame:
    """Rows with a severity and, without regard to case, a text in one of the columns."""
    return rows.where((F.col("severity") >= least) & F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def access_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count_distinct("email").alias("users"))


def retain_newest(rows: DataFrame, by: str, most: int, drop: int) -> DataFrame:
    """All rows up to `most`, beyond that without the `drop` oldest; `by` is unique."""
    if rows.limit(most + 1).count() <= most:
        return rows
    return rows.join(rows.select(by).orderBy(by).limit(drop), by, "left_anti")  # each task keeps its `drop` oldest


def run_stats(log: DataFrame) -> DataFrame:
    """(status, runs, mean_seconds, longest) of a run log (status, seconds)."""
    return log.groupBy("status").agg(
        F.count("*").alias("runs"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.max("seconds").alias("longest")
    )


def of_org(rows: DataFrame, org: str, org_col: str = "org_id") -> DataFrame:
    """The rows that an organisation may see."""
    return rows.where(F.col(org_col) == org)


def dimension_map(columns: list[str]) -> Column:
    """map<string, string> of dimensions by name, without those that are null."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("string") for c in columns)))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def against_baseline(actual: DataFrame, base: DataFrame, dims: list[str]) -> DataFrame:
    """actual (dims, v) with each segment's baseline mean, the overall mean where it has none."""
    means = base.groupBy(*dims).agg(F.avg("v").alias("_m"))
    overall = base.agg(F.avg("v").alias("_all"))
    out = actual.join(means, dims, "left").crossJoin(F.broadcast(overall))
    return out.withColumn("baseline", F.coalesce("_m", "_all")).drop("_m", "_all")
