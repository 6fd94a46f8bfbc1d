"""Exact percentiles against Spark's own; no task holds a column's values."""

from pyspark.sql import functions as F

from lakesignal.operators import cleaning
from lakesignal.operators.quantiles import one_row, percentiles

AT = (0.0, 0.21, 0.25, 0.5, 0.75, 0.79, 1.0)


def table(spark):
    g = F.col("id") % 3
    v = F.when(F.col("id") % 11 != 0, F.when(F.col("id") % 2 == 0, F.lit(7.5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 8.0))
    w = F.when(g != 2, F.when(F.col("id") % 400 == 1, F.lit(float("inf"))).when(F.col("id") % 401 == 1, F.lit(float("nan"))).otherwise(F.col("id") * 0.1))
    return spark.range(3000).select("id", g.alias("g"), v.alias("v"), w.alias("w"))


def test_same_as_percentile(spark):
    t, at = table(spark), F.array(*map(F.lit, AT))
    want = {}
    for r in t.groupBy("g").agg(*(F.struct(F.count(c), F.count_distinct(c), F.percentile(c, at)).alias(c) for c in ("v", "w"))).collect():
        want |= {(r["g"], c): tuple(map(str, r[c])) for c in ("v", "w") if r[c][0]}
    got = {(r["g"], r["column"]): tuple(map(str, (r["n"], r["distinct"], r["at"]))) for r in percentiles(t, ["v", "w"], AT, ["g"]).collect()}
    assert got == want and len(got) == 5
    empty = one_row(t.where("id < 0"), {"m": ("v", 0.5)}).collect()
    assert [r["m"] for r in empty] == [None]


def test_steps_hold_no_column(spark):
    t = table(spark).select("id", "v")
    steps = [cleaning.outliers(t, "v", "iqr", "median"), cleaning.outliers(t, "v", "zscore", "cap"), cleaning.normalise(t, ["v"], "robust"), cleaning.fill_missing(t, {"v": "median"})]
    for df in steps:
        assert df.count() == 3000
        assert "percentile(v" not in df._jdf.queryExecution().optimizedPlan().toString()
    a, m, b = t.agg(F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75))))).first()[0]
    low, high = a - 1.5 * (b - a), b + 1.5 * (b - a)
    got = {r.id: r.v for r in steps[0].collect()}
    assert got == {r.id: m if r.v is not None and not low <= r.v <= high else r.v for r in t.collect()}
