"""Profiling, validation and cleaning queries over a spoilt orders table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, quality
from ..operators.quality import Rule
from ..sources import tables as sources
from ..sources.tables import load


def dirty(spark, sf_dir):
    """orders with missing prices and priorities, a constant and a mostly null column, and repeated rows."""
    o = load(spark, sf_dir, "orders").where("o_orderkey is not null")
    k = F.col("o_orderkey")
    d = o.select(
        "o_orderkey",
        F.when(k % 10 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 15 != 0, F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("order_date"),
        F.lit("x").alias("source"),
        F.when(k % 20 == 0, 1.5).alias("sparse"),
    )
    again = F.when(k % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.withColumn("copy", F.explode(again)).withColumn("row_id", k * 2 + F.col("copy")).drop("copy")


D = """
d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price,
        CASE WHEN o_orderkey % 15 <> 0 THEN o_orderpriority END AS priority, o_orderstatus AS status, o_orderdate AS order_date,
        'x' AS source, CASE WHEN o_orderkey % 20 = 0 THEN 1.5 END AS sparse, o_orderkey * 2 + c AS row_id
      FROM orders, (VALUES (0), (1)) v(c) WHERE c = 0 OR o_orderkey % 50 = 0)"""
COLS = ["price", "priority", "status", "source", "sparse"]
RULES = (
    *quality.DEFAULT_RULES,
    Rule("price_missing", "missing", 0.05, "low", "price"),
    Rule("key_is_integer", "type", 0.0, "high", "o_orderkey", pattern="integer"),
    Rule("price_range", "range", 0.01, "high", "price", 1000, 400000),
    Rule("priority_pattern", "pattern", 0.0, "medium", "priority", pattern=r"\d-[A-Z]"),
    Rule("positive", "expression", 0.2, "critical", pattern="price > 0"),
)


def plain(spark, sf_dir):
    return dirty(spark, sf_dir).drop("order_date", "row_id")


def _profile_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM d" for c in COLS)
    return f"""WITH {D}, x AS ({cells}), r AS (SELECT "column", v, count(*) AS c FROM x GROUP BY 1, 2)
        SELECT "column", CAST(sum(c) AS BIGINT) AS n, CAST(coalesce(sum(c) FILTER (v IS NULL), 0) AS BIGINT) AS nulls,
               count(v) AS "distinct", array_to_string(list_sort(list(v) FILTER (v IS NOT NULL AND k <= 5)), '|') AS samples
        FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v NULLS LAST) AS k FROM r) GROUP BY 1"""


ALL = "o_orderkey, price, priority, status, source, sparse"
P = f"p AS (SELECT {ALL} FROM d)"
TEXT_OF = "'^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$'"
NULLS = "+".join(f"count(*) FILTER ({c.strip()} IS NULL)" for c in ALL.split(","))
METRICS = f"""SELECT count(*) AS rows, 6 AS columns, CAST({NULLS} AS BIGINT) AS missing,
  round(100.0 * ({NULLS}) / (count(*) * 6), 2) AS missing_percent,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS duplicates,
  {"+".join(f"CAST(count(*) FILTER ({c.strip()} IS NULL) > 0 AS INTEGER)" for c in ALL.split(","))} AS columns_with_nulls,
  {"+".join(f"CAST(2 * count(*) FILTER ({c.strip()} IS NULL) >= count(*) AS INTEGER)" for c in ALL.split(","))} AS half_null_columns,
  {"+".join(f"CAST(count(DISTINCT {c.strip()}) <= 1 AS INTEGER)" for c in ALL.split(","))} AS constant_columns,
  {"+".join(f"CAST(coalesce(CASE WHEN avg({c}) = 0 THEN stddev_samp({c}) < 0.01 ELSE stddev_samp({c}) / abs(avg({c})) < 0.01 END, false) AS INTEGER)" for c in ("o_orderkey", "price", "sparse"))} AS low_variance_columns
  FROM p"""
RESULTS = f"""results AS (
  SELECT 'missing_values' AS rule, 'high' AS severity, round(CAST({NULLS} AS DOUBLE) / (count(*) * 6), 6) AS value, value <= 0.2 AS passed FROM p
  UNION ALL SELECT 'duplicate_rows', 'medium', v, v <= 0.1 FROM (SELECT round(1 - u.n / t.n, 6) AS v FROM
    (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM p)) u, (SELECT count(*) AS n FROM p) t)
  UNION ALL SELECT 'constant_columns', 'medium', CAST({"+".join(f"CAST(count(DISTINCT {c.strip()}) <= 1 AS INTEGER)" for c in ALL.split(","))} AS DOUBLE) AS v, v <= 0 FROM p
  UNION ALL SELECT 'minimum_rows', 'high', CAST(count(*) AS DOUBLE) AS v, v >= 10 FROM p
  UNION ALL SELECT 'price_missing', 'low', round(CAST(count(*) FILTER (price IS NULL) AS DOUBLE) / count(*), 6) AS v, v <= 0.05 FROM p
  UNION ALL SELECT 'key_is_integer', 'high', round(CAST(count(*) FILTER (NOT regexp_matches(CAST(o_orderkey AS VARCHAR), '^[+-]?[0-9]+$')) AS DOUBLE) / count(o_orderkey), 6) AS v, v <= 0 FROM p
  UNION ALL SELECT 'price_range', 'high', round(CAST(count(*) FILTER (price NOT BETWEEN 1000 AND 400000) AS DOUBLE) / count(*), 6) AS v, v <= 0.01 FROM p
  UNION ALL SELECT 'priority_pattern', 'medium', round(CAST(count(*) FILTER (NOT regexp_matches(coalesce(priority, 'nan'), '^(?:[0-9]-[A-Z])')) AS DOUBLE) / count(*), 6) AS v, v <= 0 FROM p
  UNION ALL SELECT 'positive', 'critical', round(CAST(count(*) FILTER (NOT coalesce(price > 0, false)) AS DOUBLE) / count(*), 6) AS v, v <= 0.2 FROM p)"""
FACTS = """types AS (
  SELECT 'o_orderkey' AS "column", 'integer' AS inferred UNION ALL SELECT 'price', CASE WHEN (SELECT count(*) FROM d WHERE price IS NOT NULL) = 0
     THEN 'unknown' ELSE 'float' END UNION ALL SELECT 'priority', 'categorical' UNION ALL SELECT 'status', 'categorical'
  UNION ALL SELECT 'order_date', 'datetime' UNION ALL SELECT 'source', 'categorical' UNION ALL SELECT 'sparse', 'categorical')"""
TYPED = ["o_orderkey", "price", "priority", "status", "order_date", "source", "sparse"]


def types(spark, sf_dir):
    return quality.infer_types(dirty(spark, sf_dir), "row_id", TYPED)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


QUERIES = {
    "a23_column_profile": lambda sp, d: quality.profile(dirty(sp, d), COLS),
    "o23_infer_types": types,
    "f16_dimensions": lambda sp, d: quality.dimensions(types(sp, d), quality.profile(dirty(sp, d), TYPED)),
    "f17_time_column": lambda sp, d: quality.time_column(types(sp, d)),
    "a10_quality_metrics": lambda sp, d: quality.quality_metrics(plain(sp, d)),
    "a11_validation_rules": lambda sp, d: quality.validate(plain(sp, d), RULES),
    "a19_overall_status": lambda sp, d: quality.overall(quality.validate(plain(sp, d), RULES)),
    "a16_range_offenders": lambda sp, d: quality.offenders(dirty(sp, d), "price", 1000, 400000, "row_id"),
    "w19_drop_duplicates": lambda sp, d: cleaning.drop_duplicates(dirty(sp, d).drop("order_date"), "row_id").select("row_id", "price"),
    "f09_drop_constant": lambda sp, d: cleaning.drop_constant(plain(sp, d)),
    "f10_drop_mostly_null": lambda sp, d: cleaning.drop_mostly_null(plain(sp, d)),
    "f11_outliers_iqr": lambda sp, d: cleaning.outliers(dirty(sp, d), "price").select("row_id", "outlier"),
    "f12_outliers_zscore": lambda sp, d: cleaning.outliers(dirty(sp, d), "price", "zscore").select("row_id", "outlier"),
    "f13_outliers_capped": lambda sp, d: rounded(cleaning.outliers(dirty(sp, d), "price", "iqr", "cap").select("row_id", "price"), "price"),
    "f13_outliers_removed": lambda sp, d: cleaning.outliers(dirty(sp, d), "price", "iqr", "remove").select("row_id"),
    "f13_outliers_median": lambda sp, d: rounded(cleaning.outliers(dirty(sp, d), "price", "iqr", "median").select("row_id", "price"), "price"),
    "a20_fill_missing": lambda sp, d: rounded(
        cleaning.fill_missing(dirty(sp, d), {"price": "mean", "priority": "mode", "sparse": "zero"}).select("row_id", "price", "priority", "sparse"), "price"
    ),
    "a20_fill_median": lambda sp, d: rounded(cleaning.fill_missing(dirty(sp, d), {"price": "median"}).select("row_id", "price"), "price"),
    "a21_scale_standard": lambda sp, d: rounded(cleaning.normalise(dirty(sp, d), ["price"]).select("row_id", "price_normalized"), "price_normalized"),
    "a21_scale_minmax": lambda sp, d: rounded(cleaning.normalise(dirty(sp, d), ["price"], "minmax").select("row_id", "price_normalized"), "price_normalized"),
    "a21_scale_robust": lambda sp, d: rounded(cleaning.normalise(dirty(sp, d), ["price"], "robust").select("row_id", "price_normalized"), "price_normalized"),
    "a22_category_codes": lambda sp, d: cleaning.category_codes(dirty(sp, d), "priority"),
    "a22_label_encoding": lambda sp, d: cleaning.encode(dirty(sp, d), "priority").select("row_id", "priority_encoded"),
    "a22_one_hot": lambda sp, d: cleaning.encode(dirty(sp, d), "status", "one_hot").drop("order_date", "source", "sparse", "price", "priority", "o_orderkey"),
    "d02_time_features": lambda sp, d: cleaning.time_features(dirty(sp, d).select("row_id", "order_date"), "order_date").drop("order_date"),
    "o01_clean": lambda sp, d: rounded(cleaning.clean(dirty(sp, d), "row_id", "order_date").drop("order_date", "o_orderkey_normalized"), "price", "price_normalized"),
    "s09_rows_as_text": lambda sp, d: sources.rows_as_text(plain(sp, d).dropDuplicates(["o_orderkey"]).select("o_orderkey", "status", "priority"), ["o_orderkey"]),
    "s15_admit_documents": lambda sp, d: sources.admit_documents(load(sp, d, "documents"), "doc_id", "text"),
    "r04_json_props": lambda sp, d: load(sp, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n")),
    "u04_values_not_allowed": lambda sp, d: dirty(sp, d).select("status").distinct().exceptAll(sp.createDataFrame([("F",), ("O",)], "status string")),
}

STATS = "st AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, quantile_cont(price, 0.5) AS m FROM d)"
OUT = "coalesce(price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a), false)"
MODE = "(SELECT priority FROM d WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
SQL = {
    "a23_column_profile": _profile_sql(),
    "o23_infer_types": f"WITH {D}, {FACTS} SELECT * FROM types",
    "f16_dimensions": f"""WITH {D} SELECT 'priority' AS "column", count(DISTINCT priority) AS "distinct" FROM d
        UNION ALL SELECT 'status', count(DISTINCT status) FROM d""",
    "f17_time_column": "SELECT 'order_date' AS \"column\"",
    "a10_quality_metrics": f"WITH {D}, {P} {METRICS}",
    "a11_validation_rules": f"WITH {D}, {P}, {RESULTS} SELECT * FROM results",
    "a19_overall_status": f"""WITH {D}, {P}, {RESULTS} SELECT CASE WHEN bool_or(NOT passed AND severity IN ('high', 'critical')) THEN 'failed'
        WHEN bool_or(NOT passed) THEN 'warning' ELSE 'passed' END AS status,
        round(avg(CAST(passed AS DOUBLE)), 4) AS pass_ratio, bool_or(NOT passed) AS has_warnings FROM results""",
    "a16_range_offenders": f"WITH {D} SELECT row_id, price FROM d WHERE price NOT BETWEEN 1000 AND 400000 ORDER BY row_id LIMIT 5",
    "w19_drop_duplicates": f"WITH {D} SELECT row_id, price FROM d QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY row_id) = 1",
    "f09_drop_constant": f"WITH {D} SELECT o_orderkey, price, priority, status FROM d",
    "f10_drop_mostly_null": f"WITH {D} SELECT o_orderkey, price, priority, status, source FROM d",
    "f11_outliers_iqr": f"WITH {D}, {STATS} SELECT row_id, {OUT} AS outlier FROM d, st",
    "f12_outliers_zscore": f"""WITH {D}, m AS (SELECT quantile_cont(price, 0.5) AS mid FROM d),
        z AS (SELECT avg(coalesce(price, mid)) AS mean, stddev_pop(coalesce(price, mid)) AS sd FROM d, m)
        SELECT row_id, coalesce(price < mean - 3 * sd OR price > mean + 3 * sd, false) AS outlier FROM d, z""",
    "f13_outliers_capped": f"""WITH {D}, {STATS} SELECT row_id, round(CASE WHEN price IS NOT NULL THEN
        greatest(least(price, b + 1.5 * (b - a)), a - 1.5 * (b - a)) END, 4) AS price FROM d, st""",
    "f13_outliers_removed": f"WITH {D}, {STATS} SELECT row_id FROM d, st WHERE NOT {OUT}",
    "f13_outliers_median": f"WITH {D}, {STATS} SELECT row_id, round(CASE WHEN {OUT} THEN m ELSE price END, 4) AS price FROM d, st",
    "a20_fill_missing": f"""WITH {D} SELECT row_id, round(coalesce(price, (SELECT avg(price) FROM d)), 4) AS price,
        coalesce(priority, {MODE}) AS priority, CAST(coalesce(sparse, 0.0) AS DOUBLE) AS sparse FROM d""",
    "a20_fill_median": f"WITH {D} SELECT row_id, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d)), 4) AS price FROM d",
    "a21_scale_standard": f"""WITH {D}, z AS (SELECT avg(price) AS m, stddev_samp(price) AS sd FROM d)
        SELECT row_id, round((price - m) / sd, 4) AS price_normalized FROM d, z""",
    "a21_scale_minmax": f"""WITH {D}, z AS (SELECT min(price) AS lo, max(price) AS hi FROM d)
        SELECT row_id, round((price - lo) / (hi - lo), 4) AS price_normalized FROM d, z""",
    "a21_scale_robust": f"WITH {D}, {STATS} SELECT row_id, round((price - m) / (b - a), 4) AS price_normalized FROM d, st",
    "a22_category_codes": f"""WITH {D} SELECT priority AS category, count(*) AS n, CAST(row_number() OVER (ORDER BY priority) - 1 AS INTEGER) AS code
        FROM d WHERE priority IS NOT NULL GROUP BY 1""",
    "a22_label_encoding": f"""WITH {D}, c AS (SELECT priority AS p, CAST(row_number() OVER (ORDER BY priority) - 1 AS INTEGER) AS code
        FROM d WHERE priority IS NOT NULL GROUP BY 1) SELECT row_id, code AS priority_encoded FROM d LEFT JOIN c ON p = priority""",
    "a22_one_hot": f"""WITH {D} SELECT row_id, status, CAST(status = 'F' AS INTEGER) AS "status_F", CAST(status = 'O' AS INTEGER) AS "status_O",
        CAST(status = 'P' AS INTEGER) AS "status_P" FROM d""",
    "d02_time_features": f"""WITH {D} SELECT row_id, year(order_date) AS order_date_year, month(order_date) AS order_date_month,
        day(order_date) AS order_date_day, hour(order_date) AS order_date_hour, minute(order_date) AS order_date_minute,
        second(order_date) AS order_date_second, isodow(order_date) - 1 AS order_date_dayofweek, dayofyear(order_date) AS order_date_dayofyear,
        weekofyear(order_date) AS order_date_week, quarter(order_date) AS order_date_quarter,
        isodow(order_date) >= 6 AS order_date_is_weekend FROM d""",
    "o01_clean": f"""WITH {D}, u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY row_id) = 1),
        f AS (SELECT row_id, o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM u)) AS price, coalesce(priority,
          (SELECT priority FROM u WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority, status, order_date FROM u),
        z AS (SELECT avg(price) AS m, stddev_samp(price) AS sd FROM f)
        SELECT row_id, CAST(o_orderkey AS DOUBLE) AS o_orderkey, round(price, 4) AS price, priority, status, year(order_date) AS order_date_year,
          month(order_date) AS order_date_month, isodow(order_date) - 1 AS order_date_dayofweek, isodow(order_date) >= 6 AS order_date_is_weekend,
          round((price - m) / sd, 4) AS price_normalized FROM f, z""",
    "s09_rows_as_text": f"""WITH {D}, u AS (SELECT DISTINCT o_orderkey, status, priority FROM d),
        r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM u ORDER BY o_orderkey LIMIT 500)
        SELECT 0 AS n, 'Headers: o_orderkey, status, priority' AS line UNION ALL
        SELECT CAST(n AS INTEGER), 'Row ' || n || ': ' || concat_ws('; ', 'o_orderkey: ' || o_orderkey, 'status: ' || status, 'priority: ' || priority) FROM r""",
    "s15_admit_documents": "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL",
    "r04_json_props": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "u04_values_not_allowed": f"WITH {D} SELECT DISTINCT status FROM d WHERE status NOT IN ('F', 'O')",
}
