"""Detection queries over the hourly series of events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, series
from ..sources.tables import load


def hourly(spark, sf_dir):
    """Sum of values by event type and hour."""
    e = load(spark, sf_dir, "events")
    return series.prepare(e, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"))


def several(spark, sf_dir):
    """Three metrics of the orders by week."""
    o = load(spark, sf_dir, "orders")
    metrics = {"price": F.col("o_totalprice"), "orders": F.lit(1), "urgent": (F.col("o_orderpriority") == "1-URGENT").cast("int")}
    return series.prepare_metrics(o, F.date_trunc("week", "o_orderdate"), metrics)


def gappy(spark, sf_dir):
    """The series with every seventh value missing."""
    return hourly(spark, sf_dir).withColumn("v", F.when(F.col("idx") % 7 != 3, F.col("v")))


def scored(spark, sf_dir):
    s = hourly(spark, sf_dir)
    return scoring.score(series.ensemble(s), s)


def flagship(spark, sf_dir):
    """Hourly series, four detectors, votes, scores, the severe ones first."""
    return scoring.most_severe(scored(spark, sf_dir), 0.15)


S = """
s0 AS (SELECT event_type AS key, date_trunc('hour', ts) AS t, round(sum(value), 2) AS v FROM events
       WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
s AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS INTEGER) AS idx, v FROM s0)"""
DIRECTION = "CASE WHEN score > 0 THEN 'spike' ELSE 'drop' END AS kind"


def flagged(score: str, threshold: float, source: str = "s", kind: str = DIRECTION) -> str:
    """CTE body: rows of source beyond the threshold."""
    return (
        f"SELECT key, idx, v, round(score, 4) AS score, {kind} FROM (SELECT *, round({score}, 9) AS score FROM {source})"
        f" WHERE abs(score) > {threshold}"
    )


Z_SOURCE = "(SELECT *, avg(v) OVER k AS m, stddev_samp(v) OVER k AS sd, count(v) OVER k AS n FROM s WINDOW k AS (PARTITION BY key))"
Z = flagged("CASE WHEN sd > 0 AND n >= 10 THEN (v - m) / sd END", 3.0, Z_SOURCE)


def rolling(window: int, threshold: float, least: int = 10) -> str:
    source = (
        "(SELECT *, avg(v) OVER p AS m, stddev_samp(v) OVER p AS sd, count(v) OVER p AS n, count(*) OVER (PARTITION BY key) AS all_n"
        f" FROM s WINDOW p AS (PARTITION BY key ORDER BY idx ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING))"
    )
    return flagged(
        f"CASE WHEN n >= {min(least, window)} AND all_n >= 10 THEN (v - m) / greatest(sd, 1e-9) END", threshold, source
    )


IQR_SOURCE = (
    "(SELECT s.*, a, b, b - a AS span FROM s JOIN (SELECT key, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b,"
    " count(*) AS n FROM s GROUP BY key) USING (key) WHERE b > a AND n >= 10)"
)
IQR = flagged(
    "CASE WHEN v > b + 1.5 * span THEN (v - (b + 1.5 * span)) / span WHEN v < a - 1.5 * span THEN (v - (a - 1.5 * span)) / span END",
    0.0,
    IQR_SOURCE,
)
TREND = (
    "(SELECT *, v - trend AS residual FROM (SELECT *, quantile_cont(v, 0.5) OVER"
    " (PARTITION BY key ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM s))"
)
SEASONAL_SOURCE = (
    "(SELECT *, avg(residual) OVER k AS m, stddev_samp(residual) OVER k AS sd, count(*) OVER k AS n FROM "
    + TREND
    + " WINDOW k AS (PARTITION BY key))"
)
SEASONAL = flagged("CASE WHEN sd > 0 AND n >= 14 THEN (residual - m) / sd END", 3.5, SEASONAL_SOURCE)
CONTEXT_SOURCE = (
    "(SELECT *, avg(v) OVER k AS m, stddev_samp(v) OVER k AS sd, count(v) OVER k AS n FROM (SELECT *, idx % 24 AS grp FROM s)"
    " WINDOW k AS (PARTITION BY key, grp))"
)
CONTEXT = flagged(
    "CASE WHEN sd > 0 AND n >= 10 THEN (v - m) / sd END", 2.0, CONTEXT_SOURCE,
    "CASE WHEN score > 0 THEN 'contextual_spike' ELSE 'contextual_drop' END AS kind",
)
COLLECTIVE = f"""
SELECT key, idx, v, max(abs(score)) OVER w AS score, 'collective' AS kind FROM (
  SELECT *, idx - row_number() OVER (PARTITION BY key ORDER BY idx) AS island FROM ({rolling(5, 2.5, 5)})
) WINDOW w AS (PARTITION BY key, island) QUALIFY count(*) OVER w >= 2"""
CUSUM = """
SELECT key, idx, v, round(greatest(up, down) / 5.0, 4) AS score, CASE WHEN up >= down THEN 'spike' ELSE 'drop' END AS kind
FROM (
  SELECT *, round(cu - least(0, min(cu) OVER w), 6) AS up, round(cd - least(0, min(cd) OVER w), 6) AS down FROM (
    SELECT *, sum(d - CASE WHEN idx > 0 THEN 0.5 ELSE 0 END) OVER w AS cu,
              sum(-d - CASE WHEN idx > 0 THEN 0.5 ELSE 0 END) OVER w AS cd FROM (
      SELECT s.*, CASE WHEN idx > 0 THEN (v - m) / sd ELSE 0 END AS d
      FROM s JOIN (SELECT key, avg(v) FILTER (idx < 10) AS m, stddev_pop(v) FILTER (idx < 10) AS sd, count(*) AS n
                   FROM s GROUP BY key) USING (key) WHERE sd > 0 AND n >= 20
    ) WINDOW w AS (PARTITION BY key ORDER BY idx ROWS UNBOUNDED PRECEDING)
  ) WINDOW w AS (PARTITION BY key ORDER BY idx ROWS UNBOUNDED PRECEDING)
) WHERE greatest(up, down) > 5"""
PETTITT = """
SELECT key, idx, round(u, 4) AS u, round(least(1.0, 2 * exp(-6 * u * u / (n ** 3 + n ** 2))), 6) AS p FROM (
  SELECT *, 2 * sum(r) OVER (PARTITION BY key ORDER BY idx ROWS UNBOUNDED PRECEDING) - (idx + 1) * (n + 1) AS u FROM (
    SELECT *, rank() OVER (PARTITION BY key ORDER BY v) + (count(*) OVER (PARTITION BY key, v) - 1) / 2.0 AS r,
           CAST(count(*) OVER (PARTITION BY key) AS DOUBLE) AS n FROM s)
) WHERE n >= 20 AND idx + 1 BETWEEN 10 AND n - 10
QUALIFY row_number() OVER (PARTITION BY key ORDER BY abs(u) DESC, idx) = 1"""
ENSEMBLE = f"""
z AS ({Z}), q AS ({IQR}), ma AS ({rolling(7, 3.0)}), se AS ({SEASONAL}),
votes AS (SELECT *, 0 AS place FROM z UNION ALL SELECT *, 1 FROM q UNION ALL SELECT *, 2 FROM ma UNION ALL SELECT *, 3 FROM se),
kinds AS (SELECT key, idx, kind, any_value(v) AS v, count(*) AS n, min(place) AS place, sum(abs(score)) AS total,
                 max(abs(score)) AS top FROM votes GROUP BY ALL),
found AS (SELECT key, idx, any_value(v) AS v, CAST(sum(n) AS BIGINT) AS votes, arg_max(kind, n * 10 - place) AS kind,
                 round(sum(total) / sum(n), 6) AS mean_score, max(top) AS max_score FROM kinds GROUP BY key, idx)"""
SCORED = f"""{S}, {ENSEMBLE},
peaks AS (SELECT key, idx, v >= quantile_cont(v, 0.99) OVER w OR v <= quantile_cont(v, 0.01) OVER w AS peak FROM s
          WINDOW w AS (PARTITION BY key ORDER BY idx ROWS 29 PRECEDING)),
per_key AS (SELECT key, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM s GROUP BY key),
c AS (SELECT *, round(a - 1.5 * (b - a), 4) AS expected_min, round(b + 1.5 * (b - a), 4) AS expected_max,
             round(60 * votes / 4 + 30 * least(mean_score / 5, 1.0)
                   + 10 * least(abs(v - median) / greatest(abs(median), 1e-10), 1.0), 4) AS confidence
      FROM found JOIN peaks USING (key, idx) JOIN per_key USING (key)),
d AS (SELECT *, round(least(1.0, (0.6 * confidence / 100 + 0.4 * least(max_score / 6, 1.0))
                   * CASE WHEN kind IN ('spike', 'drop') THEN 1.2 ELSE 1.0 END * CASE WHEN peak THEN 1.2 ELSE 1.0 END), 4) AS severity FROM c),
scored AS (SELECT key, idx, v, votes, kind, expected_min, expected_max, confidence, severity,
                  CASE WHEN severity < 0.2 THEN 'Low' WHEN severity < 0.4 THEN 'Medium' WHEN severity < 0.7 THEN 'High'
                       ELSE 'Critical' END AS level FROM d)"""


def _range_sql(low: str, high: str, source: str = "s") -> str:
    return f"WITH {S} SELECT key, round({low}, 4) AS low, round({high}, 4) AS high FROM {source} GROUP BY key"


A, B = "quantile_cont(v, 0.25)", "quantile_cont(v, 0.75)"
on = lambda f, **kw: lambda spark, d: f(hourly(spark, d), **kw)
over = lambda f: lambda spark, d: f(scored(spark, d))

QUERIES = {
    "f01_prepare_series": lambda sp, d: hourly(sp, d).select("key", "idx", "v"),
    "f03_min_periods": lambda sp, d: series.long_series(hourly(sp, d), 678).groupBy("key").agg(F.count("*").alias("n")),
    "a01_zscore": on(series.zscore),
    "a02_iqr": on(series.iqr),
    "w01_rolling_zscore": on(series.rolling_zscore),
    "w02_moving_average": on(series.moving_average),
    "w03_centred_median": lambda sp, d: series.seasonal_residual(hourly(sp, d)).select("key", "idx", F.round("trend", 4).alias("trend"), F.round("residual", 4).alias("residual")),
    "w04_seasonal": on(series.seasonal),
    "a04_contextual": lambda sp, d: series.contextual(hourly(sp, d), F.col("idx") % 24),
    "w06_collective": on(series.collective),
    "w07_cusum": on(series.cusum),
    "w08_pettitt": on(series.pettitt),
    "w10_change_points": on(series.change_points, significance=1.1),
    "w11_interpolate": lambda sp, d: series.fill(gappy(sp, d)).select("key", "idx", F.round("v", 4).alias("v")),
    "w12_forward_fill": lambda sp, d: series.fill(gappy(sp, d), "forward").select("key", "idx", "v"),
    "w12_backward_fill": lambda sp, d: series.fill(gappy(sp, d), "backward").select("key", "idx", "v"),
    "w05_peaks": on(lambda s: scoring.peaks(s).select("key", "idx", "peak")),
    "a06_ensemble": on(series.ensemble),
    "m04_score_anomalies": scored,
    "f04_severity_filter": flagship,
    "t02_top_severity": lambda sp, d: scoring.most_severe(scored(sp, d), 0.0, 20),
    "a03_range_iqr": on(scoring.expected_range),
    "a03_range_std": on(scoring.expected_range, method="std"),
    "a03_range_percentile_last": on(scoring.expected_range, method="percentile", last=100),
    "a07_detection_summary": over(scoring.detection_summary),
    "a48_several_metrics": lambda sp, d: series.ensemble(several(sp, d)),
    "a08_analysis_summary": over(scoring.summary),
    "a09_dashboard": over(scoring.dashboard),
}

KEYED = "(PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "(PARTITION BY key ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
GAPPY = "g AS (SELECT key, idx, CASE WHEN idx % 7 <> 3 THEN v END AS v, CASE WHEN idx % 7 <> 3 THEN idx END AS known FROM s)"

SQL = {
    "f01_prepare_series": f"WITH {S} SELECT * FROM s",
    "f03_min_periods": f"WITH {S} SELECT key, count(*) AS n FROM s GROUP BY key HAVING count(*) >= 678",
    "a01_zscore": f"WITH {S} {Z}",
    "a02_iqr": f"WITH {S} {IQR}",
    "w01_rolling_zscore": f"WITH {S} {rolling(24, 3.0)}",
    "w02_moving_average": f"WITH {S} {rolling(7, 3.0)}",
    "w03_centred_median": f"WITH {S} SELECT key, idx, round(trend, 4) AS trend, round(residual, 4) AS residual FROM {TREND}",
    "w04_seasonal": f"WITH {S} {SEASONAL}",
    "a04_contextual": f"WITH {S} {CONTEXT}",
    "w06_collective": f"WITH {S} {COLLECTIVE}",
    "w07_cusum": f"WITH {S} {CUSUM}",
    "w08_pettitt": f"WITH {S} {PETTITT}",
    "w10_change_points": f"WITH {S}, c AS ({PETTITT}) SELECT s.key, s.idx, s.v, CAST(0.5 AS DOUBLE) AS score, 'collective' AS kind"
    " FROM s JOIN c ON s.key = c.key AND abs(s.idx - c.idx) <= 2",
    "w11_interpolate": f"""WITH {S}, {GAPPY}, h AS (
        SELECT key, idx, v, last_value(v IGNORE NULLS) OVER {KEYED} AS a, first_value(v IGNORE NULLS) OVER {AHEAD} AS b,
               last_value(known IGNORE NULLS) OVER {KEYED} AS i, first_value(known IGNORE NULLS) OVER {AHEAD} AS j FROM g)
        SELECT key, idx, round(coalesce(v, CASE WHEN j > i THEN a + (b - a) * (idx - i) / (j - i) END, a, b), 4) AS v FROM h""",
    "w12_forward_fill": f"WITH {S}, {GAPPY} SELECT key, idx, last_value(v IGNORE NULLS) OVER {KEYED} AS v FROM g",
    "w12_backward_fill": f"WITH {S}, {GAPPY} SELECT key, idx, first_value(v IGNORE NULLS) OVER {AHEAD} AS v FROM g",
    "w05_peaks": f"WITH {SCORED} SELECT key, idx, peak FROM peaks",
    "a06_ensemble": f"WITH {S}, {ENSEMBLE} SELECT * FROM found",
    "m04_score_anomalies": f"WITH {SCORED} SELECT * FROM scored",
    "f04_severity_filter": f"WITH {SCORED} SELECT * FROM scored WHERE severity >= 0.15",
    "t02_top_severity": f"WITH {SCORED} SELECT * FROM scored ORDER BY severity DESC, key, idx LIMIT 20",
    "a03_range_iqr": _range_sql(f"{A} - 1.5 * ({B} - {A})", f"{B} + 1.5 * ({B} - {A})"),
    "a03_range_std": _range_sql("avg(v) - 3 * stddev_samp(v)", "avg(v) + 3 * stddev_samp(v)"),
    "a03_range_percentile_last": _range_sql(
        "quantile_cont(v, 0.01)", "quantile_cont(v, 0.99)",
        "(SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) <= 100)",
    ),
    "a07_detection_summary": f"WITH {SCORED} SELECT count(*) AS total, round(avg(severity), 4) AS mean_severity,"
    " round(avg(confidence), 4) AS mean_confidence, count(DISTINCT key) AS keys, (SELECT string_agg(DISTINCT key, ',' ORDER BY key) FROM scored) AS affected,"
    " (SELECT string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) FROM (SELECT kind, count(*) AS n FROM scored GROUP BY 1)) AS by_kind,"
    " (SELECT string_agg(level || ':' || n, ',' ORDER BY level || ':' || n) FROM (SELECT level, count(*) AS n FROM scored GROUP BY 1)) AS by_level FROM scored",
    "a48_several_metrics": f"""WITH m AS (SELECT date_trunc('week', o_orderdate) AS t, o_totalprice AS price, 1 AS orders, CAST(o_orderpriority = '1-URGENT' AS INT) AS urgent FROM orders),
        s0 AS (SELECT 'price' AS key, t, round(sum(price), 2) AS v FROM m GROUP BY t UNION ALL SELECT 'orders', t, sum(orders) FROM m GROUP BY t UNION ALL SELECT 'urgent', t, sum(urgent) FROM m GROUP BY t),
        s AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS INTEGER) AS idx, v FROM s0), {ENSEMBLE} SELECT * FROM found""",
    "a08_analysis_summary": f"WITH {SCORED} SELECT kind, level, count(*) AS n, round(avg(severity), 4) AS mean_severity,"
    " max(severity) AS max_severity FROM scored GROUP BY GROUPING SETS ((kind), (level), ())",
    "a09_dashboard": f"WITH {SCORED} SELECT count(*) FILTER (severity >= 0.8) AS critical,"
    " count(*) FILTER (severity >= 0.5 AND severity < 0.8) AS warning, count(*) FILTER (severity < 0.5) AS info,"
    " count(*) FILTER (kind = 'drop') AS drops, count(*) FILTER (kind = 'collective') AS collective,"
    " count(*) FILTER (kind NOT IN ('drop', 'collective')) AS spikes FROM scored",
}
