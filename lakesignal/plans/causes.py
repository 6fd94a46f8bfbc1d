"""Root-cause queries over lineitem days and events hours, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import root_cause as rc
from ..operators import series
from ..sources.tables import load
from . import detection as det

DIMS = ["flag", "status", "line"]


def panel(spark, sf_dir):
    """lineitem by month: (t, flag, status, line, v)."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.date_trunc("month", "l_shipdate").alias("t"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").cast("string").alias("line"), F.col("l_extendedprice").alias("v"),
    ).where("t is not null and v is not null")


def anomalies(spark, sf_dir):
    """Every month that has eight months before it, ids by time."""
    p = panel(spark, sf_dir).groupBy("t").agg(F.round(F.sum("v"), 2).alias("value"))
    n = F.row_number().over(Window.orderBy("t"))  # a row a month
    return p.withColumn("n", n).where("n > 8").select((F.col("n") - 8).alias("anomaly_id"), "t", "value")


def seg(spark, sf_dir, median=False):
    return rc.segments(panel(spark, sf_dir), anomalies(spark, sf_dir), DIMS, median=median)


def wide(spark, sf_dir):
    """Events by hour: (idx, value, n, users, top)."""
    h = load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("t")).agg(
        F.round(F.sum("value"), 2).alias("total"), F.count("*").cast("double").alias("n"),
        F.count_distinct("user_id").cast("double").alias("users"), F.max("value").alias("top"),
    )
    return h.withColumn("idx", F.row_number().over(Window.orderBy("t")) - 1).drop("t")


METRICS = ["total", "n", "users", "top"]
ks = ["anomaly_id", "dimension", "segment"]


#: Means of amounts in cents lie half way between four digits now and then, where engines round differently; a shift avoids it.
SHIFT = 0.0000137


def r4(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


def impact_cells(spark, sf_dir):
    return rc.impact_cells(panel(spark, sf_dir), anomalies(spark, sf_dir), DIMS)


def months(spark, sf_dir):
    """(t, revenue, lines, quantity, discount) by month."""
    li = load(spark, sf_dir, "lineitem").where("l_shipdate is not null and l_extendedprice is not null")
    return li.groupBy(F.date_trunc("month", "l_shipdate").alias("t")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count("*").cast("double").alias("order_lines"),
        F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 9).alias("discount"),
    )


def related(spark, sf_dir):
    """Correlations of the other monthly figures with revenue, for each anomaly."""
    c = rc.correlation_significance(rc.correlations(months(spark, sf_dir), ["revenue", "order_lines", "quantity", "discount"]))
    c = c.where("a = 'revenue'").select(F.col("b").alias("other"), "r", "p")
    return anomalies(spark, sf_dir).select("anomaly_id").crossJoin(F.broadcast(c))  # three rows


def change_points(spark, sf_dir, significance=0.05):
    a = anomalies(spark, sf_dir)
    w = rc.change_window(months(spark, sf_dir).select("t", F.col("revenue").alias("v")), a)
    return rc.changes(w, series.pettitt(w), a, significance)


def methods(spark, sf_dir):
    """The arguments of insights and evidence."""
    v = F.col("value")
    a = anomalies(spark, sf_dir).select("anomaly_id", F.lit("net_revenue").alias("metric"), "value", (v * 0.7).alias("low"), (v * 0.9).alias("high"))
    s = rc.contributions(rc.segment_significance(seg(spark, sf_dir)))
    return a, s, rc.attribution(s), related(spark, sf_dir), change_points(spark, sf_dir)


def resampled(spark, sf_dir):
    """Intervals of the segments' impacts, for all anomalies."""
    li = load(spark, sf_dir, "lineitem").withColumn("row_id", F.struct("l_orderkey", "l_linenumber"))
    p = li.select("row_id", F.date_trunc("month", "l_shipdate").alias("t"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
                  F.col("l_linenumber").cast("string").alias("line"), F.col("l_extendedprice").alias("v")).where("t is not null and v is not null")
    return rc.bootstrap_all(p, anomalies(spark, sf_dir), DIMS)


def pairs(spark, sf_dir):
    """Orders (left) and events of the same key to match as of a time."""
    c = load(spark, sf_dir, "events").where("ts is not null")
    left = c.where("event_type = 'error'").select("event_id", (F.col("user_id") % 10).alias("grp"), "ts")
    right = c.where("event_type = 'purchase'").groupBy((F.col("user_id") % 10).alias("grp"), "ts").agg(F.min("event_id").alias("purchase_id"))
    return left, right


PANEL = """
p AS (SELECT date_trunc('month', l_shipdate) AS t, l_returnflag AS flag, l_linestatus AS status, CAST(l_linenumber AS VARCHAR) AS line,
        l_extendedprice AS v FROM lineitem WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL),
m AS (SELECT t, round(sum(v), 2) AS value FROM p GROUP BY 1),
an AS (SELECT CAST(n - 8 AS INTEGER) AS anomaly_id, t, value FROM (SELECT *, row_number() OVER (ORDER BY t) AS n FROM m) WHERE n > 8),
bt AS (SELECT anomaly_id, m.t, false AS now FROM an JOIN m ON m.t < an.t
       QUALIFY row_number() OVER (PARTITION BY anomaly_id ORDER BY m.t DESC) <= 7),
ar AS (SELECT anomaly_id, now, p.* FROM p JOIN (SELECT * FROM bt UNION ALL SELECT anomaly_id, t, true FROM an) x USING (t))"""
SEG = f"""{PANEL},
lg AS (SELECT anomaly_id, now, v, 'flag' AS dimension, flag AS segment FROM ar UNION ALL
       SELECT anomaly_id, now, v, 'status', status FROM ar UNION ALL SELECT anomaly_id, now, v, 'line', line FROM ar),
seg AS (SELECT *, mean * now_rows AS expected, actual - mean * now_rows AS deviation, actual / nullif(mean * now_rows, 0) AS ratio FROM (
  SELECT anomaly_id, dimension, segment, coalesce(sum(v) FILTER (now), 0.0) AS actual, avg(v) FILTER (NOT now) AS mean,
         stddev_samp(v) FILTER (NOT now) AS sd, quantile_cont(v, 0.5) FILTER (NOT now) AS median,
         count(*) FILTER (NOT now) AS size, count(*) FILTER (now) AS now_rows FROM lg GROUP BY ALL) WHERE size >= 10)"""
ATT = f"""{SEG},
att AS (SELECT *, 100 * abs(pct) / sum(abs(pct)) OVER w AS share FROM (
  SELECT *, 100 * deviation / sum(abs(deviation)) OVER (PARTITION BY anomaly_id, dimension) AS pct FROM seg
) WHERE abs(round(pct, 6)) >= 1 WINDOW w AS (PARTITION BY anomaly_id, dimension))"""
WIDE = """
h AS (SELECT date_trunc('hour', ts) AS t, round(sum(value), 2) AS total, CAST(count(*) AS DOUBLE) AS n,
        CAST(count(DISTINCT user_id) AS DOUBLE) AS users, max(value) AS top FROM events GROUP BY 1),
w AS (SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS idx, total, n, users, top FROM h)"""
PAIRS = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]


def corr_sql(source: str = "w", digits: int = 6) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), {digits}) AS r FROM {source}" for a, b in PAIRS
    )


RANKS = "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0 AS {m}" for m in METRICS) + " FROM w)"
SUBSETS = [()] + [c for k in (1, 2, 3) for c in rc.combinations(DIMS, k)]


def shapley_sql() -> str:
    """Three dimensions: a coalition of none or two others weighs 1/3, of one 1/6."""
    worth = ["SELECT anomaly_id, '' AS c, now_rows * overall AS w FROM tot"]
    for s in SUBSETS[1:]:
        cols = ", ".join(s)
        worth.append(
            f"SELECT c.anomaly_id, '{'|'.join(s)}' AS c, sum(coalesce(mean, overall)) AS w FROM (SELECT * FROM ar WHERE now) c JOIN tot USING (anomaly_id)"
            f" LEFT JOIN (SELECT anomaly_id, {cols}, avg(v) AS mean FROM ar WHERE NOT now GROUP BY ALL) USING (anomaly_id, {cols}) GROUP BY 1"
        )
    weight = {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}
    gains = " UNION ALL ".join(
        f"SELECT anomaly_id, '{d}' AS dimension, {weight[len(s)]} * (x.w - y.w) AS g FROM (SELECT * FROM worth WHERE c = '{'|'.join(x for x in DIMS if x in {*s, d})}') x"
        f" JOIN (SELECT * FROM worth WHERE c = '{'|'.join(s)}') y USING (anomaly_id)"
        for d in DIMS
        for s in SUBSETS
        if d not in s
    )
    return (
        f"WITH {PANEL}, {IMPACT}, worth AS MATERIALIZED ({' UNION ALL '.join(worth)}), sv AS (SELECT anomaly_id, dimension, sum(g) AS value FROM ({gains}) GROUP BY ALL)"
        " SELECT anomaly_id, dimension, round(value, 2) AS value, round(100 * value / sum(value) OVER (PARTITION BY anomaly_id), 4) AS percent FROM sv"
    )


IMPACT = """tot AS (SELECT anomaly_id, sum(v) FILTER (now) - count(*) FILTER (now) * avg(v) FILTER (NOT now) AS impact, count(*) FILTER (now) AS now_rows,
  avg(v) FILTER (NOT now) AS overall FROM ar GROUP BY 1)"""


def anomaly_interaction_sql() -> str:
    parts = [
        f"SELECT anomaly_id, '{a} x {b}' AS pair, {a} AS x, {b} AS y, value, (b1 + b2) / 2 AS baseline FROM (SELECT anomaly_id, {a}, {b}, sum(v) AS value FROM ar WHERE now GROUP BY ALL)"
        f" JOIN (SELECT anomaly_id, {a}, avg(v) AS b1 FROM ar WHERE NOT now GROUP BY ALL) USING (anomaly_id, {a}) JOIN (SELECT anomaly_id, {b}, avg(v) AS b2 FROM ar WHERE NOT now GROUP BY ALL) USING (anomaly_id, {b})"
        for a, b in rc.combinations(DIMS, 2)
    ]
    return (
        f"WITH {PANEL}, {IMPACT} SELECT anomaly_id, pair, x, y, round(value + {SHIFT:.7f}, 2) AS value, round(baseline + {SHIFT:.7f}, 2) AS baseline, round(value - baseline + {SHIFT:.7f}, 2) AS effect,"
        f" round(100 * (value - baseline) / impact + {SHIFT:.7f}, 2) AS percent, CASE WHEN value > baseline THEN 'synergistic' ELSE 'diminishing' END AS kind"
        f" FROM ({' UNION ALL '.join(parts)}) JOIN tot USING (anomaly_id) WHERE abs(value - baseline) > abs(impact) / 100"
    )


def interaction_sql() -> str:
    parts = []
    for a, b in rc.combinations(DIMS, 2):
        parts.append(
            f"SELECT x, y, '{a}*{b}' AS pair, round(value, 4) AS value, round(effect, 4) AS effect,"
            f" CASE WHEN round(effect, 6) > 0 THEN 'synergistic' ELSE 'diminishing' END AS kind FROM (SELECT c.{a} AS x, c.{b} AS y, value,"
            f" value - (b1 + b2) / 2 AS effect FROM (SELECT {a}, {b}, avg(v) AS value FROM p GROUP BY 1, 2) c"
            f" JOIN (SELECT {a}, avg(v) AS b1 FROM p GROUP BY 1) USING ({a}) JOIN (SELECT {b}, avg(v) AS b2 FROM p GROUP BY 1) USING ({b}))"
        )
    return f"WITH {PANEL} " + " UNION ALL ".join(parts)


#: Two-sided p of t with df degrees of freedom: 1 - twice Simpson's sum of the density from 0 to |t|, over 2,000 steps.
def p_sql(t: str, df: str) -> str:
    top = f"least(abs({t}), 60.0)"
    density = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * pow(1 + pow({top} * i / 2000, 2) / {df}, -({df} + 1) / 2.0)"
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"greatest(0.0, 1 - 2 * {top} / 6000 * list_sum(list_transform(range(0, 2001), lambda i: {weight} * {density})))"


SIGNIFICANT = f"""{SEG},
sp AS (SELECT *, CASE WHEN sd > 0 AND now_rows > 0 THEN {p_sql("t", "(size - 1)")} WHEN actual / nullif(now_rows, 0) = mean THEN 1.0 ELSE 0.0 END AS p,
    coalesce(100 * abs(deviation) / nullif(sum(abs(deviation)) OVER (PARTITION BY anomaly_id, dimension), 0), 0.0) AS contribution
  FROM (SELECT *, (actual / nullif(now_rows, 0) - mean) / nullif(sd / sqrt(size), 0) AS t FROM seg))"""
MONTHS = """mo AS (SELECT date_trunc('month', l_shipdate) AS t, round(sum(l_extendedprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS order_lines, sum(l_quantity) AS quantity,
  round(avg(l_discount), 9) AS discount FROM lineitem WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1)"""
CHANGES = """cw AS (SELECT anomaly_id AS key, an.t AS at_time, mo.t, revenue AS v, CAST(row_number() OVER (PARTITION BY anomaly_id ORDER BY mo.t) - 1 AS INTEGER) AS idx FROM
  (SELECT anomaly_id, t, row_number() OVER (PARTITION BY anomaly_id ORDER BY mt DESC) AS back, mt FROM (SELECT an.*, mo.t AS mt FROM an JOIN mo ON mo.t <= an.t)) an
  JOIN mo ON mo.t = mt WHERE back <= 61),
cp AS (SELECT *, max(abs(u)) OVER (PARTITION BY key) AS top FROM (SELECT *, 2 * sum(r) OVER (PARTITION BY key ORDER BY idx ROWS UNBOUNDED PRECEDING) - (idx + 1) * (n + 1) AS u FROM (
  SELECT *, rank() OVER (PARTITION BY key ORDER BY v) + (count(*) OVER (PARTITION BY key, v) - 1) / 2.0 AS r, CAST(count(*) OVER (PARTITION BY key) AS DOUBLE) AS n FROM cw))
  WHERE n >= 20 AND idx + 1 BETWEEN 10 AND n - 10),
cq AS (SELECT key, idx, n, round(least(1.0, 2 * exp(-6 * pow(u, 2) / (n ** 3 + n ** 2))), 6) AS p FROM cp WHERE abs(u) = top QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx) = 1),
ch AS (SELECT key AS anomaly_id, any_value(cw.t) FILTER (cw.idx = cq.idx + 1) AS changed_at, 1 - any_value(p) AS confidence,
    (avg(v) FILTER (cw.idx > cq.idx) - avg(v) FILTER (cw.idx <= cq.idx)) / stddev_pop(v) AS magnitude,
    date_diff('day', any_value(cw.t) FILTER (cw.idx = cq.idx + 1), any_value(at_time)) AS days
  FROM cw JOIN cq USING (key) WHERE p < LEAST_P AND cq.idx + 1 < 0.8 * n GROUP BY key)"""
RELATED = " UNION ALL ".join(f"SELECT '{m}' AS other, corr(revenue, {m}) AS r, count(*) AS n FROM mo" for m in ("order_lines", "quantity", "discount"))
EVIDENCE = f"""{SIGNIFICANT}, {MONTHS}, {CHANGES.replace('LEAST_P', '0.05')}, rr AS ({RELATED}),
rel AS (SELECT *, {p_sql("t", "(n - 2)")} AS p FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM rr)),
att AS (SELECT *, 100 * abs(pct) / sum(abs(pct)) OVER w AS share FROM (
  SELECT *, 100 * deviation / sum(abs(deviation)) OVER (PARTITION BY anomaly_id, dimension) AS pct FROM seg
) WHERE abs(round(pct, 6)) >= 1 WINDOW w AS (PARTITION BY anomaly_id, dimension)),
dr AS (SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY round(share, 2) DESC, dimension, segment) AS k, count(*) OVER (PARTITION BY anomaly_id) AS n_drivers FROM att),
ts AS (SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY round(abs(deviation), 4) DESC, dimension, segment) AS k, count(*) OVER w AS n_seg,
    count(*) FILTER (p < 0.05) OVER w AS n_sure, avg(contribution) OVER w AS mean_contribution FROM sp WINDOW w AS (PARTITION BY anomaly_id)),
tr AS (SELECT * FROM rel ORDER BY round(abs(r), 6) DESC, other LIMIT 1),
ins AS (SELECT an.anomaly_id, value, value - (value * 0.7 + value * 0.9) / 2 AS imp, dr.n_drivers, dr.dimension AS top_dimension, dr.segment AS top_segment, round(dr.pct, 2) AS pct,
    round(dr.share, 2) AS top_share, ts.segment AS seg, ts.ratio, ts.contribution, ts.p AS seg_p, n_seg, n_sure, mean_contribution, tr.other, tr.r, tr.p AS rel_p,
    (SELECT count(*) FROM rel) AS n_rel, (SELECT count(*) FROM rel WHERE p < 0.05) AS n_rel_sure, ch.confidence AS sure, ch.magnitude, ch.days
  FROM an LEFT JOIN dr ON an.anomaly_id = dr.anomaly_id AND dr.k = 1 LEFT JOIN ts ON an.anomaly_id = ts.anomaly_id AND ts.k = 1 CROSS JOIN tr LEFT JOIN ch ON ch.anomaly_id = an.anomaly_id)"""
JOIN_SIDES = """
l AS (SELECT event_id, user_id % 10 AS grp, ts FROM events WHERE event_type = 'error' AND ts IS NOT NULL),
r AS (SELECT user_id % 10 AS grp, ts, min(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL GROUP BY 1, 2)"""
wide_q = lambda f: lambda sp, d: f(wide(sp, d))

QUERIES = {
    "j03_asof_nearest": lambda sp, d: rc.asof(*pairs(sp, d), "grp", "ts", ["purchase_id"], "nearest").select("event_id", "purchase_id"),
    "j04_asof_backward": lambda sp, d: rc.asof(*pairs(sp, d), "grp", "ts", ["purchase_id"]).select("event_id", "purchase_id"),
    "w15_baseline_times": lambda sp, d: rc.baseline_times(panel(sp, d), anomalies(sp, d)).groupBy("anomaly_id").agg(F.count("*").alias("n"), F.date_format(F.min("t"), "yyyy-MM").alias("first")),
    "j02_baseline_semi_join": lambda sp, d: panel(sp, d).join(rc.baseline_times(panel(sp, d), anomalies(sp, d)).select("t").distinct(), "t", "left_semi").groupBy("flag").agg(F.count("*").alias("n")),
    "a24_segments": lambda sp, d: seg(sp, d, True).withColumns({c: F.round(F.col(c) + SHIFT, 4) for c in ("actual", "mean", "sd", "median", "expected", "deviation", "ratio")}),
    "a25_contributions": lambda sp, d: rc.contributions(seg(sp, d)).select(*ks, F.round("contribution", 4).alias("contribution")),
    "t03_top_segments": lambda sp, d: rc.top_segments(seg(sp, d)).select(*ks, "rank"),
    "a26_segment_t": lambda sp, d: rc.segment_significance(seg(sp, d)).select(*ks, F.round("t_stat", 4).alias("t_stat")),
    "a33_attribution": lambda sp, d: rc.attribution(seg(sp, d)).select(*ks, F.round("pct", 4).alias("pct"), F.round("share", 4).alias("share")),
    "a36_interactions": lambda sp, d: r4(rc.all_interactions(panel(sp, d), DIMS), "value", "effect"),
    "a36_anomaly_interactions": lambda sp, d: rc.anomaly_interactions(impact_cells(sp, d), DIMS).withColumns({c: F.round(F.col(c) + SHIFT, 2) for c in ("value", "baseline", "effect", "percent")}),
    "a38_shapley": lambda sp, d: rc.shapley_of_cells(impact_cells(sp, d), DIMS).withColumns({"value": F.round("value", 2), "percent": F.round("percent", 4)}),
    "j06_correlation_matrix": wide_q(lambda w: rc.correlations(w, METRICS).withColumn("r", F.round("r", 6))),
    "a28_spearman": wide_q(lambda w: rc.correlations(w, METRICS, "spearman").withColumn("r", F.round("r", 6))),
    "a27_pearson_p": wide_q(lambda w: rc.correlation_significance(rc.correlations(w, METRICS)).select("a", "b", F.round("t_stat", 3).alias("t_stat"), F.round("p", 6).alias("p"))),
    "a30_multiple_testing": wide_q(lambda w: rc.adjust(rc.correlations(w, METRICS).withColumn("p", F.round(1 - F.abs("r"), 6))).select("a", "b", F.round("bonferroni", 6).alias("bonferroni"), F.round("bh", 6).alias("bh"))),
    "a29_lagged_correlation": wide_q(lambda w: rc.lagged(w, "total", "users").withColumn("c", F.round("c", 6))),
    "a29_best_lag": wide_q(lambda w: rc.best_lag(rc.lagged(w, "total", "users")).withColumn("c", F.round("c", 6))),
    "a31_most_variable": wide_q(lambda w: rc.most_variable(w, METRICS, 3).withColumn("variance", F.round("variance", 4))),
    "w13_correlation_window": wide_q(lambda w: rc.correlations(rc.window_before(w, 400), METRICS).withColumn("r", F.round("r", 6))),
    "m06_change_magnitude": lambda sp, d: r4(rc.change_magnitude(det.hourly(sp, d), series.pettitt(det.hourly(sp, d))), "before", "after", "magnitude"),
    "a34_expected_value": lambda sp, d: rc.expected_value(det.hourly(sp, d)).withColumn("expected", F.round("expected", 4)),
    "a40_insights": lambda sp, d: rc.insights(*methods(sp, d)).drop("drivers"),
    "a41_evidence": lambda sp, d: rc.evidence(*methods(sp, d)),
    "d03_days_since_change": lambda sp, d: change_points(sp, d, 1.1).select("anomaly_id", F.date_format("changed_at", "yyyy-MM-dd").alias("changed_at"), "days"),
    "w14_change_window": lambda sp, d: rc.change_window(months(sp, d).select("t", F.col("revenue").alias("v")), anomalies(sp, d)).groupBy("key").agg(F.count("*").alias("n"), F.date_format(F.min("t"), "yyyy-MM").alias("first"), F.date_format(F.max("t"), "yyyy-MM").alias("last")),
    "k05_insight_json": lambda sp, d: rc.insights(*methods(sp, d)).select("anomaly_id", F.to_json(F.struct("metric", "top_dimension", "top_segment")).alias("json")),
    "a37_bootstrap": resampled,
    "a26_segment_p": lambda sp, d: rc.segment_significance(seg(sp, d)).select(*ks, F.round("p", 6).alias("p")),
}
SQL = {
    "j03_asof_nearest": f"""WITH {JOIN_SIDES},
        b AS (SELECT l.event_id, r.ts AS bt, r.purchase_id AS bp FROM l ASOF LEFT JOIN r ON l.grp = r.grp AND l.ts >= r.ts),
        f AS (SELECT l.event_id, r.ts AS ft, r.purchase_id AS fp FROM l ASOF LEFT JOIN r ON l.grp = r.grp AND l.ts <= r.ts)
        SELECT event_id, CASE WHEN bt IS NULL OR (ft IS NOT NULL AND epoch_us(ft) - epoch_us(l.ts) < epoch_us(l.ts) - epoch_us(bt)) THEN fp ELSE bp END AS purchase_id
        FROM l JOIN b USING (event_id) JOIN f USING (event_id)""",
    "j04_asof_backward": f"WITH {JOIN_SIDES} SELECT l.event_id, r.purchase_id FROM l ASOF LEFT JOIN r ON l.grp = r.grp AND l.ts >= r.ts",
    "w15_baseline_times": f"WITH {PANEL} SELECT anomaly_id, count(*) AS n, strftime(min(t), '%Y-%m') AS first FROM bt GROUP BY 1",
    "j02_baseline_semi_join": f"WITH {PANEL} SELECT flag, count(*) AS n FROM p WHERE t IN (SELECT t FROM bt) GROUP BY 1",
    "a24_segments": f"WITH {SEG} SELECT anomaly_id, dimension, segment, size, now_rows, "
    + ", ".join(f"round({c} + {SHIFT:.7f}, 4) AS {c}" for c in ("actual", "mean", "sd", "median", "expected", "deviation", "ratio")) + " FROM seg",
    "a25_contributions": f"WITH {SEG} SELECT anomaly_id, dimension, segment, round(100 * abs(deviation) / sum(abs(deviation)) OVER (PARTITION BY anomaly_id, dimension), 4) AS contribution FROM seg",
    "t03_top_segments": f"""WITH {SEG} SELECT anomaly_id, dimension, segment, CAST(row_number() OVER
        (PARTITION BY anomaly_id ORDER BY round(abs(deviation), 4) DESC, dimension, segment) AS INTEGER) AS rank FROM seg QUALIFY rank <= 10""",
    "a26_segment_t": f"""WITH {SEG} SELECT anomaly_id, dimension, segment,
        round(CASE WHEN sd > 0 AND now_rows > 0 THEN (actual / now_rows - mean) / (sd / sqrt(size)) END, 4) AS t_stat FROM seg""",
    "a33_attribution": f"WITH {ATT} SELECT anomaly_id, dimension, segment, round(pct, 4) AS pct, round(share, 4) AS share FROM att",
    "a36_interactions": interaction_sql(),
    "a36_anomaly_interactions": anomaly_interaction_sql(),
    "a38_shapley": shapley_sql(),
    "j06_correlation_matrix": f"WITH {WIDE} {corr_sql()}",
    "a28_spearman": f"WITH {WIDE}, {RANKS} {corr_sql('rk')}",
    "a27_pearson_p": f"WITH {WIDE}, c AS ({corr_sql(digits=15)}), u AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c) SELECT a, b, round(t, 3) AS t_stat, round({p_sql('t', '(n - 2)')}, 6) AS p FROM u",
    "a30_multiple_testing": f"""WITH {WIDE}, c AS ({corr_sql(digits=15)}), t AS (SELECT a, b, round(1 - abs(r), 6) AS p FROM c),
        q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, a, b) AS q, count(*) OVER () AS m FROM t)
        SELECT a, b, round(least(1.0, p * m), 6) AS bonferroni, round(least(1.0, min(q) OVER (ORDER BY p DESC, a DESC, b DESC)), 6) AS bh FROM q""",
    "a29_lagged_correlation": f"""WITH {WIDE}, z AS (SELECT idx, (total - avg(total) OVER ()) / stddev_pop(total) OVER () AS x,
        (users - avg(users) OVER ()) / stddev_pop(users) OVER () AS y, count(*) OVER () AS cnt FROM w),
        l AS (SELECT CAST(unnest(range(-24, 25)) AS INTEGER) AS lag)
        SELECT lag, round(sum(a.x * b.y) / any_value(a.cnt), 6) AS c FROM z a, l, z b WHERE b.idx = a.idx + lag AND abs(lag) <= a.cnt // 4 GROUP BY lag""",
    "a29_best_lag": f"""WITH {WIDE}, z AS (SELECT idx, (total - avg(total) OVER ()) / stddev_pop(total) OVER () AS x,
        (users - avg(users) OVER ()) / stddev_pop(users) OVER () AS y, count(*) OVER () AS cnt FROM w),
        l AS (SELECT CAST(unnest(range(-24, 25)) AS INTEGER) AS lag), g AS (
        SELECT lag, sum(a.x * b.y) / any_value(a.cnt) AS c FROM z a, l, z b WHERE b.idx = a.idx + lag AND abs(lag) <= a.cnt // 4 GROUP BY lag)
        SELECT lag, round(c, 6) AS c, CASE WHEN lag > 0 THEN 'leads' WHEN lag < 0 THEN 'lags' ELSE 'together' END AS direction
        FROM g ORDER BY round(abs(c), 9) DESC, abs(lag), lag LIMIT 1""",
    "a31_most_variable": f"""WITH {WIDE}, u AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, var_samp({m}) AS variance FROM w" for m in METRICS)})
        SELECT metric, round(variance, 4) AS variance FROM u ORDER BY u.variance DESC, metric LIMIT 3""",
    "w13_correlation_window": f"WITH {WIDE}, ww AS (SELECT * FROM w WHERE idx >= 316 AND idx < 484) {corr_sql('ww')}",
    "m06_change_magnitude": f"""WITH {det.S}, c AS ({det.PETTITT}) SELECT s.key, round(avg(s.v) FILTER (s.idx <= c.idx), 4) AS before,
        round(avg(s.v) FILTER (s.idx > c.idx), 4) AS after,
        round((avg(s.v) FILTER (s.idx > c.idx) - avg(s.v) FILTER (s.idx <= c.idx)) / stddev_pop(s.v), 4) AS magnitude FROM s JOIN c USING (key) GROUP BY s.key""",
    "a34_expected_value": f"""WITH {det.S}, x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS r, count(*) OVER (PARTITION BY key) AS n FROM s)
        SELECT key, round(avg(v), 4) AS expected FROM x WHERE r <= least(7, n // 2) GROUP BY key""",
    "a26_segment_p": f"WITH {SIGNIFICANT} SELECT anomaly_id, dimension, segment, round(p, 6) AS p FROM sp",
    "w14_change_window": f"WITH {PANEL}, {MONTHS}, {CHANGES.replace('LEAST_P', '0.05')} SELECT key, count(*) AS n, strftime(min(t), '%Y-%m') AS first, strftime(max(t), '%Y-%m') AS last FROM cw GROUP BY 1",
    "d03_days_since_change": f"WITH {PANEL}, {MONTHS}, {CHANGES.replace('LEAST_P', '1.1')} SELECT anomaly_id, strftime(changed_at, '%Y-%m-%d') AS changed_at, CAST(days AS INTEGER) AS days FROM ch",
    "a41_evidence": f"""WITH {EVIDENCE} SELECT anomaly_id, coalesce(n_seg, 0) AS segments, coalesce(n_sure, 0) AS significant_segments, round(coalesce(mean_contribution, 0), 4) AS mean_contribution,
        n_rel AS correlations, round(abs(r), 6) AS strongest_correlation, n_rel_sure AS significant_correlations, days IS NOT NULL AS changed, round(sure, 4) AS change_confidence,
        round(magnitude, 4) AS change_magnitude, CAST(days AS INTEGER) AS days_since_change, coalesce(n_drivers, 0) AS factors, top_dimension AS top_contributor FROM ins""",
    "a40_insights": f"""WITH {EVIDENCE} SELECT anomaly_id, 'net_revenue' AS metric, round(imp, 4) AS impact, coalesce(n_drivers, 0) AS n_drivers, top_dimension, top_segment, top_share,
        round(least(1.0, 0.25 * CASE WHEN seg_p < 0.05 THEN 1.0 WHEN seg IS NOT NULL THEN 0.3 ELSE 0.1 END + 0.2 * abs(r)
          + 0.15 * CASE WHEN sure > 0.8 THEN 1.0 WHEN sure > 0.6 THEN 0.7 WHEN sure IS NOT NULL THEN 0.4 ELSE 0.5 END
          + 0.2 * CASE WHEN abs(pct) > 40 THEN 1.0 WHEN abs(pct) > 20 THEN 0.7 WHEN pct IS NOT NULL THEN 0.4 ELSE 0.3 END
          + 0.2 * ((seg IS NOT NULL)::INT + 1 + (sure IS NOT NULL)::INT + (pct IS NOT NULL)::INT) / 4.0), 3) AS confidence,
        concat_ws(' ', CASE WHEN seg IS NULL THEN 'Anomaly detected in Net Revenue.' ELSE CASE WHEN ratio < 0.7 THEN 'Net Revenue drop primarily driven by ' WHEN ratio > 1.3 THEN 'Net Revenue spike primarily driven by '
            ELSE 'Anomaly in Net Revenue concentrated in ' END || seg || ' (' || printf('%.1f', round(contribution, 1)) || '% contribution).' END,
          CASE WHEN rel_p < 0.05 THEN 'Correlated with ' || CASE other WHEN 'order_lines' THEN 'Order Lines' WHEN 'quantity' THEN 'Quantity' ELSE 'Discount' END || ' (r=' || printf('%.2f', round(abs(r), 2)) || ').' END,
          CASE WHEN sure > 0.7 THEN 'Behavior change detected ' || days || ' days before.' END,
          upper(top_dimension[1]) || top_dimension[2:] || ' (' || top_segment || ') accounts for ' || printf('%.1f', round(pct, 1)) || '% of total impact.') AS hypothesis FROM ins""",
    "k05_insight_json": f"""WITH {EVIDENCE} SELECT anomaly_id, '{{"metric":"net_revenue"' || CASE WHEN top_dimension IS NULL THEN '' ELSE ',"top_dimension":"' || top_dimension || '","top_segment":"' || top_segment || '"' END || '}}' AS json FROM ins""",
}
