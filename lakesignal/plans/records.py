"""Metadata, explanation, figure, set and streaming queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import explain as ex
from ..operators import figures, records
from ..sources import sinks
from ..sources.tables import load, shared_folder
from ..streaming import jobs, stateful


def datasets(spark, sf_dir):
    """Customers as datasets."""
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_mktsegment").alias("org_id"), F.col("c_acctbal").alias("size"))


def anomalies(spark, sf_dir):
    """Orders as anomalies."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("anomaly_id"), F.col("o_custkey").alias("dataset_id"), F.col("o_orderpriority").alias("metric"),
        F.when(F.col("o_orderstatus") == "F", "drop").otherwise("spike").alias("kind"), (F.col("o_totalprice") / 524288).alias("severity"),
    )


def causes(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("anomaly_id")).agg(F.max("l_returnflag").alias("cause"))


def explanations(spark, sf_dir):
    return load(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("anomaly_id"), F.concat(F.lit("see "), "o_orderpriority").alias("text"))


def access_log(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("u"), F.col("user_id"), F.lit("@x"))).alias("email"), F.col("event_type").alias("action"))


def versions(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("version"), F.col("event_type").alias("status"), "value")


def found(spark, sf_dir):
    """All orders as anomalies with causes: drivers are their lines, some have dimensions, correlations, a change point or a hypothesis."""
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    share = 100 * F.col("l_extendedprice") / F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("segment"), share.alias("contribution"), (F.col("l_quantity") / 25).alias("baseline_ratio"))
    first = F.array_sort(F.collect_list(F.struct("l_linenumber", "segment", "contribution", "baseline_ratio")))
    drivers = lines.groupBy("l_orderkey").agg(F.transform(first, lambda x: F.struct(x["segment"].alias("segment"), x["contribution"].alias("contribution"), x["baseline_ratio"].alias("baseline_ratio"))).alias("d"))
    related = F.array(*(F.struct(F.lit(n).alias("metric"), r.alias("coefficient"), (c % 50 / 1000).alias("p_value")) for n, r in (("net_revenue", (c % 200 - 100) / 100), ("order_lines", c % 7 / 8), ("discount", c % 11 / 16))))
    change = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("detected_at"), (k % 100 / 100).alias("confidence"), (price / 2).alias("before_mean"), price.alias("after_mean"))
    kind = F.when(k % 11 == 0, "contextual_drop").when(F.col("o_orderstatus") == "F", "drop").otherwise("spike")
    o = load(spark, sf_dir, "orders").join(drivers, k == F.col("l_orderkey"), "left")
    return o.select(
        k.alias("anomaly_id"), F.concat(F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("_order_value")).alias("metric"), price.alias("value"), kind.alias("kind"),
        (F.lit(150000.0) + c % 7 * 1000).alias("expected_min"), F.lit(250000.0).alias("expected_max"), F.lit(200000.0).alias("expected"), F.col("o_orderdate").alias("at"),
        (price / 524288).alias("severity"), (k % 1000 / 10).alias("confidence"), (c % 100 / 100).alias("cause_confidence"),
        F.when(k % 2 == 0, F.create_map(F.lit("order_status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")).alias("dimensions"),
        F.when(k % 3 != 0, F.col("d")).alias("drivers"), F.when(k % 5 != 0, related).alias("correlations"), F.when(k % 4 == 1, change).alias("change_point"),
        F.when(k % 7 != 0, F.concat(F.lit("Driven by "), "o_orderpriority")).alias("hypothesis"), (k % 13 != 0).alias("wants_recommendations"),
        F.when(k % 6 == 0, F.array(F.struct(F.lit("Prices rose in spring.").alias("text"), (k % 100 / 100).alias("score")))).alias("context"),
    )


def context_queries(spark, sf_dir):
    asked = F.when(F.col("anomaly_id") % 3 == 0, "Why did it change?")
    return found(spark, sf_dir).select("anomaly_id", ex.context_query(F.when(F.col("anomaly_id") % 17 != 0, F.col("metric")), F.col("kind"), F.col("dimensions"), asked).alias("query"))


def explained(spark, sf_dir):
    return ex.explain(found(spark, sf_dir)).select("anomaly_id", "explanation", "summary", F.array_join("recommendations", "|").alias("recommendations"), F.array_join("evidence", "|").alias("evidence"))


def advice(spark, sf_dir):
    """Turns of conversations, each with a list of its words ahead of it and after it."""
    text = F.concat(F.lit("Intro - not an item here\nNext steps:\n1. check the upstream feed\n- short\n"), "text", F.lit("\n* call the owner of the data\n**Notes**\n- not an item either\n**- an item after no opening line"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(ex.extract_recommendations(text), "|").alias("items"))


def prints(spark, sf_dir):
    """Synthetic fingerprints from embeddings."""
    e = load(spark, sf_dir, "embeddings")
    h = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x).cast("double"))
    total = F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    fp = F.struct(
        (F.col("vec_id") * 2654435761).alias("dhash"), (F.col("vec_id") % 7 * 1099511627).alias("ahash"),
        F.slice("embedding", 1, 16).alias("ncc"), F.transform(h, lambda x: 3 * x / total).alias("histogram"),
    )
    return e.select(F.col("vec_id").alias("figure_id"), fp.alias("f"))


def best_figures(spark, sf_dir):
    p = prints(spark, sf_dir)
    return figures.best_match(p.where("figure_id % 20 = 0").select(F.col("figure_id").alias("query_id"), F.col("f").alias("q")), p, 0.5)


def cascade(spark, sf_dir):
    t = {"datasets": datasets(spark, sf_dir), "anomalies": anomalies(spark, sf_dir), "causes": causes(spark, sf_dir)}
    gone = t["datasets"].where("dataset_id % 3 = 0").select("dataset_id")
    left = records.delete_cascade(t, [("datasets", "anomalies", "dataset_id"), ("anomalies", "causes", "anomaly_id")], "datasets", "dataset_id", gone)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def streamed(spark, sf_dir, build, mode, empty_batches=True):
    """A job over the events as a stream, its last state as a table."""
    from uuid import uuid4

    path = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    e = load(spark, sf_dir, "events")
    e.write.parquet(f"{path}/in")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    jobs.run_once(build(jobs.read_table(spark, f"{path}/in", 100)), sink, f"{path}/check", mode, empty_batches)
    return spark.read.parquet(f"{path}/out").drop("batch")


def task_updates(events):
    """Events as updates of one task a user; few of them are ends."""
    done, broke = F.expr("event_type = 'purchase' and event_id % 53 = 0"), F.expr("event_type = 'error' and event_id % 31 = 0")
    return events.select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"),
        F.when(done, "completed").when(broke, "failed").otherwise("processing").alias("status"), (F.col("event_id") % 5).alias("step"),
        F.when(~broke | (F.col("event_id") % 2 == 0), F.concat(F.lit("stage "), "event_type")).alias("stage"), (F.col("event_id") * 7 % 120).alias("progress"),
        F.when(broke, F.concat(F.lit("broke at "), F.col("event_id").cast("string"))).alias("error"),
    )


def ratings(events):
    rows = events.where("event_type in ('purchase', 'error')")
    return rows.select(F.array(F.concat(F.lit("c"), F.col("user_id") % 40)).alias("keys"), (F.col("event_type") == "purchase").alias("positive"))


QUERIES = {
    "j08_findings": lambda sp, d: records.with_findings(anomalies(sp, d), causes(sp, d), explanations(sp, d)),
    "j09_anomaly_counts": lambda sp, d: records.with_counts(datasets(sp, d), anomalies(sp, d), "dataset_id", "anomaly_count"),
    "j17_cascade_delete": cascade,
    "j01_segment_baseline": lambda sp, d: records.against_baseline(
        load(sp, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v")),
        load(sp, d, "orders").where("o_orderdate < '1997-01-01' and o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v")),
        ["p", "s"],
    ).select("o_orderkey", F.round("baseline", 4).alias("baseline")),
    "j16_seen_anti_join": lambda sp, d: load(sp, d, "orders").join(load(sp, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti").select("o_orderkey"),
    "t08_page": lambda sp, d: records.page(anomalies(sp, d), [F.desc("severity"), "anomaly_id"], 40, 20),
    "f07_anomaly_filter": lambda sp, d: records.filter_anomalies(anomalies(sp, d), 0.5, "drop", "1-URGENT").select("anomaly_id"),
    "f08_search_rows": lambda sp, d: records.search_rows(anomalies(sp, d), ["metric", "kind"], "HIGH spi", 0.3).select("anomaly_id"),
    "f05_time_predicates": lambda sp, d: load(sp, d, "orders").where("o_orderdate <= timestamp'1996-06-30' and o_orderdate >= timestamp'1995-01-01'").groupBy("o_orderstatus").agg(F.count("*").alias("n")),
    "a46_access_stats": lambda sp, d: records.access_stats(access_log(sp, d)),
    "a46_latest_access": lambda sp, d: access_log(sp, d).orderBy(F.desc("event_id")).limit(200),
    "a49_retention": lambda sp, d: records.retain_newest(load(sp, d, "customer").select("c_custkey"), "c_custkey", 100, 20),
    "a50_value_counts": lambda sp, d: load(sp, d, "part").groupBy("p_type").agg(F.count("*").alias("n")),
    "k02_latest_version": lambda sp, d: sinks.latest_version(versions(sp, d), "user_id", "version", F.col("status") == "error").select("user_id", "version", "status"),
    "k06_event_envelope": lambda sp, d: sinks.event_envelope(load(sp, d, "supplier"), "dataset_uploaded", F.lit("2024-01-01"), ["s_suppkey", "s_name"], "s_suppkey").drop("timestamp"),
    "u01_union_all": lambda sp, d: load(sp, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(load(sp, d, "supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n")),
    "u02_distinct": lambda sp, d: load(sp, d, "lineitem").select("l_returnflag", "l_linestatus").distinct(),
    "u03_intersect": lambda sp, d: load(sp, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(sp, d, "supplier").select(F.col("s_nationkey").alias("k"))),
    "u05_subset": lambda sp, d: load(sp, d, "orders").groupBy("o_custkey").agg((F.size(F.array_except(F.collect_set("o_orderstatus"), F.array(F.lit("F"), F.lit("O")))) == 0).alias("subset")),
    "x22_explanations": explained,
    "x25_prompts": lambda sp, d: ex.prompt(found(sp, d)),
    "x27_context_query": context_queries,
    "m14_percent_deviation": lambda sp, d: found(sp, d).select("anomaly_id", F.round(ex.percent_deviation(F.col("value"), F.col("expected")), 6).alias("pct")),
    "x14_follow_ups": lambda sp, d: ex.rewrite_follow_ups(load(sp, d, "conversations")),
    "x24_recommendations": advice,
    "o09_usage": lambda sp, d: ex.usage(load(sp, d, "events").select(F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 3 == 0, "template").otherwise("model").alias("outcome"), (F.col("event_id") % 500).alias("tokens"), F.col("value").alias("millis"))),
    "m12_fingerprint_similarity": best_figures,
    "m13_figure_class": lambda sp, d: load(sp, d, "part").select("p_partkey", figures.figure_class((F.col("p_partkey") % 60) / 1000.0).alias("kind"), figures.aspect(F.col("p_size") * 1.0, F.col("p_partkey") % 23 * 1.0).alias("aspect")),
    "g09_hourly_stream": lambda sp, d: streamed(sp, d, jobs.hourly_totals, "update").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total"),
    "g04_feedback_stream": lambda sp, d: streamed(sp, d, lambda e: jobs.feedback_weights(ratings(e)), "update"),
    "g02_rate_limit": lambda sp, d: streamed(sp, d, lambda e: stateful.rate_limit(e.select((F.col("user_id") % 20).alias("key"), "ts"), 3600.0, 3), "append").select("key", F.round("at", 3).alias("at"), "allowed", F.round("retry_after", 3).alias("retry_after")),
    "g03_task_stream": lambda sp, d: streamed(sp, d, lambda e: stateful.task_states(task_updates(e)), "update", False).drop("seq"),
    "g03_task_states": lambda sp, d: jobs.task_states(load(sp, d, "events").select((F.col("user_id") % 50).alias("task_id"), F.element_at(F.array(*map(F.lit, ("queued", "running", "indexing", "failed", "done"))), (F.col("event_id") % 4 + 1).cast("int")).alias("status"), (F.col("event_id") % 100).alias("progress"))),
}

A = """an AS (SELECT o_orderkey AS anomaly_id, o_custkey AS dataset_id, o_orderpriority AS metric, CASE WHEN o_orderstatus = 'F' THEN 'drop' ELSE 'spike' END AS kind,
  o_totalprice / 524288 AS severity FROM orders),
ca AS (SELECT l_orderkey AS anomaly_id, max(l_returnflag) AS cause FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"""
TITLE = "array_to_string(list_transform(regexp_extract_all({}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
LEVEL = "CASE WHEN severity < 0.2 THEN 'Low' WHEN severity < 0.4 THEN 'Medium' WHEN severity < 0.7 THEN 'High' ELSE 'Critical' END"
FOUND = f"""ln AS (SELECT l_orderkey, list({{'segment': 'line ' || l_linenumber, 'contribution': share, 'ratio': l_quantity / 25}} ORDER BY l_linenumber, share, l_quantity) AS d
  FROM (SELECT *, 100 * l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS share FROM lineitem) GROUP BY 1),
f AS (SELECT *, (value - 0.5 * (low + high)) / abs(0.5 * (low + high)) * 100 AS pct, {TITLE.format("replace(metric, '_', ' ')")} AS shown FROM (
  SELECT o_orderkey AS anomaly_id, lower(substr(o_orderpriority, 3, 20)) || '_order_value' AS metric, o_totalprice AS value, 200000.0 AS expected, o_orderdate AS at_time,
  150000.0 + o_custkey % 7 * 1000 AS low, 250000.0 AS high, o_orderstatus, o_orderpriority, o_totalprice / 524288 AS severity, o_orderkey % 1000 / 10 AS confidence, o_custkey % 100 / 100 AS trust,
  CASE WHEN o_orderkey % 11 = 0 THEN 'contextual_drop' WHEN o_orderstatus = 'F' THEN 'drop' ELSE 'spike' END AS kind,
  CASE WHEN o_orderkey % 3 <> 0 THEN d END AS drivers, o_custkey AS ck FROM orders LEFT JOIN ln ON l_orderkey = o_orderkey))"""
AMOUNT = "format('{{:,.2f}}', {})"
FINGERPRINTS = """fp AS (SELECT vec_id, vec_id * 2654435761 AS dh, vec_id % 7 * 1099511627 AS ah, list_transform(embedding[1:16], lambda x: CAST(x AS DOUBLE)) AS nc,
  list_transform(embedding[1:12], lambda x: 3 * CAST(abs(x) AS DOUBLE) / list_sum(list_transform(embedding[1:12], lambda y: CAST(abs(y) AS DOUBLE)))) AS hi FROM embeddings),
fs AS (SELECT *, sqrt(list_sum(list_transform(nc, lambda x: x * x))) AS nn FROM fp)"""
SQL = {
    "m12_fingerprint_similarity": f"""WITH {FINGERPRINTS}, p AS (SELECT q.vec_id AS query_id, c.vec_id AS figure_id, round(0.4 * (1 - bit_count(xor(q.dh, c.dh)) / 64.0) + 0.25 * (1 - bit_count(xor(q.ah, c.ah)) / 64.0)
          + 0.2 * greatest(0.0, list_sum(list_transform(list_zip(q.nc, c.nc), lambda z: z[1] * z[2])) / (q.nn * c.nn + 1e-8))
          + 0.15 * list_sum(list_transform(list_zip(q.hi, c.hi), lambda z: least(z[1], z[2]))) / 3, 4) AS similarity FROM fs q JOIN fs c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, figure_id, similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, figure_id) = 1 AND similarity >= 0.5""",
    "j08_findings": f"""WITH {A}, e AS (SELECT o_orderkey AS anomaly_id, 'see ' || o_orderpriority AS text FROM orders WHERE o_orderkey % 3 = 0)
        SELECT an.*, cause, text FROM an LEFT JOIN ca USING (anomaly_id) LEFT JOIN e USING (anomaly_id)""",
    "j09_anomaly_counts": """SELECT c_custkey AS dataset_id, c_mktsegment AS org_id, c_acctbal AS size,
        (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS anomaly_count FROM customer""",
    "j17_cascade_delete": f"""WITH {A} SELECT 'datasets' AS name, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0
        UNION ALL SELECT 'anomalies', count(*) FROM an WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = dataset_id AND c_custkey % 3 = 0)
        UNION ALL SELECT 'causes', count(*) FROM ca WHERE NOT EXISTS (SELECT 1 FROM an JOIN customer ON c_custkey = dataset_id AND c_custkey % 3 = 0 WHERE an.anomaly_id = ca.anomaly_id)""",
    "j01_segment_baseline": """WITH b AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus <> 'P'),
        m AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM b GROUP BY 1, 2)
        SELECT o.o_orderkey, round(coalesce(m, (SELECT avg(o_totalprice) FROM b)), 4) AS baseline FROM orders o LEFT JOIN m USING (o_orderpriority, o_orderstatus)""",
    "j16_seen_anti_join": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "t08_page": f"WITH {A} SELECT * FROM an ORDER BY severity DESC, anomaly_id LIMIT 20 OFFSET 40",
    "f07_anomaly_filter": f"WITH {A} SELECT anomaly_id FROM an WHERE severity >= 0.5 AND kind = 'drop' AND metric = '1-URGENT'",
    "f08_search_rows": f"WITH {A} SELECT anomaly_id FROM an WHERE severity >= 0.3 AND lower(metric || ' ' || kind) LIKE '%high spi%'",
    "f05_time_predicates": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30' GROUP BY 1",
    "a46_access_stats": "SELECT count(*) AS total, count(DISTINCT CASE WHEN user_id % 4 <> 0 THEN user_id END) AS users FROM events",
    "a46_latest_access": "SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN 'u' || user_id || '@x' END AS email, event_type AS action FROM events ORDER BY event_id DESC LIMIT 200",
    "a49_retention": "SELECT c_custkey FROM customer QUALIFY (SELECT count(*) FROM customer) <= 100 OR row_number() OVER (ORDER BY c_custkey) > 20",
    "a50_value_counts": "SELECT p_type, count(*) AS n FROM part GROUP BY 1",
    "k02_latest_version": """SELECT user_id, event_id AS version, event_type AS status FROM (SELECT * FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'""",
    "k06_event_envelope": """SELECT sha256('dataset_uploaded|' || s_suppkey) AS event_id, 'dataset_uploaded' AS event_type, '1.0' AS version,
        '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' AS payload FROM supplier""",
    "u01_union_all": "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
    "u02_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "u03_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "u05_subset": "SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'O')) AS subset FROM orders GROUP BY 1",
    "x22_explanations": f"""WITH {FOUND}, p AS (SELECT *,
        '**What Happened:** On ' || strftime(at_time, '%B %d, %Y at %H:%M') || ', ' || shown || CASE WHEN value > (low + high) / 2 THEN ' increased to ' ELSE ' decreased to ' END || {AMOUNT.format("value")}
          || ', which is a ' || {LEVEL} || '-severity ' || replace(kind, '_', ' ') || '. This represents a ' || printf('%.1f', abs(pct)) || CASE WHEN value > (low + high) / 2 THEN '% increase' ELSE '% decrease' END
          || ' from the expected range of ' || {AMOUNT.format("low")} || ' – ' || {AMOUNT.format("high")} || '.' AS what,
        CASE WHEN anomaly_id % 2 = 0 THEN '**Where:** This anomaly was concentrated in Order Status: ' || o_orderstatus || ', Priority: ' || o_orderpriority || '.' END AS place,
        CASE WHEN anomaly_id % 7 <> 0 THEN '**Why:** Driven by ' || o_orderpriority END AS hypothesis,
        '**Primary Drivers:** ' || array_to_string(list_transform(drivers[1:3], lambda d: d.segment || ' (' || printf('%.1f', d.contribution) || '% contribution)'), '; ') || '.' AS driven,
        CASE WHEN anomaly_id % 5 <> 0 THEN '**Correlated Metrics:** Net Revenue (r=' || printf('%.2f', (ck % 200 - 100) / 100) || '); Order Lines (r=' || printf('%.2f', ck % 7 / 8) || '); Discount (r=' || printf('%.2f', ck % 11 / 16) || ').' END AS related,
        CASE WHEN anomaly_id % 4 = 1 THEN '**Change Point:** A behavioral shift was detected at ' || strftime(at_time, '%Y-%m-%d') || ' (confidence: ' || (anomaly_id % 100) || '%).' END AS changed,
        list_filter([CASE kind WHEN 'drop' THEN 'Investigate the cause of the ' || replace(metric, '_', ' ') || ' decline in affected segments.'
            WHEN 'spike' THEN 'Verify whether the ' || replace(metric, '_', ' ') || ' spike is genuine or caused by data quality issues.' END,
          'Focus investigation on the ' || drivers[1].segment || ' segment.',
          CASE WHEN anomaly_id % 5 <> 0 THEN 'Monitor net revenue as it shows strong correlation with this anomaly.' END,
          CASE WHEN severity > 0.7 THEN 'Set up alerts for this metric to detect recurrence early.' END,
          'Review this finding with domain experts for business context.'], lambda r: r IS NOT NULL AND anomaly_id % 13 <> 0) AS advice FROM f)
        SELECT anomaly_id, array_to_string(list_filter([what, place, coalesce(nullif(concat_ws(chr(10), hypothesis, driven, related, changed), ''),
            '**Why:** Insufficient evidence to determine a definitive root cause. Consider reviewing recent operational changes or external factors.')], lambda x: x IS NOT NULL), chr(10) || chr(10))
          || CASE WHEN len(advice) > 0 THEN chr(10) || chr(10) || 'Recommended Actions:' || chr(10) || array_to_string(list_transform(advice, lambda r, i: '  ' || i || '. ' || r), chr(10)) ELSE '' END AS explanation,
        {LEVEL} || '-severity ' || kind || CASE WHEN drivers IS NULL THEN ' detected in ' || shown || '.' ELSE ' in ' || shown || ', primarily driven by ' || drivers[1].segment || '.' END AS summary,
        array_to_string(advice, '|') AS recommendations,
        concat_ws('|', 'Observed value: ' || {AMOUNT.format("value")} || ' (expected: ' || {AMOUNT.format("low")} || ' – ' || {AMOUNT.format("high")} || ')',
          nullif(array_to_string(list_transform(drivers[1:3], lambda d: 'Driver: ' || d.segment || ' contributed ' || printf('%.1f', d.contribution) || '%'), '|'), ''),
          CASE WHEN anomaly_id % 5 <> 0 THEN 'Correlation: net_revenue (r=' || printf('%.2f', (ck % 200 - 100) / 100) || ')|Correlation: order_lines (r=' || printf('%.2f', ck % 7 / 8) || ')' END) AS evidence FROM p""",
    "x25_prompts": f"""WITH {FOUND} SELECT anomaly_id, concat_ws(chr(10), 'Please explain this business anomaly:' || chr(10), '## Anomaly Data', '- Metric: ' || metric, '- Timestamp: ' || strftime(at_time, '%Y-%m-%dT%H:%M:%S'),
        '- Observed Value: ' || {AMOUNT.format("value")}, '- Expected Range: ' || {AMOUNT.format("low")} || ' – ' || {AMOUNT.format("high")}, '- Percentage Deviation: ' || printf('%+.1f', pct) || '%', '- Type: ' || kind,
        '- Severity: ' || printf('%.2f', severity) || ' (0-1 scale)', '- Confidence: ' || printf('%.1f', confidence) || '%',
        CASE WHEN anomaly_id % 2 = 0 THEN '- Affected Segments: order_status=' || o_orderstatus || ', priority=' || o_orderpriority END,
        chr(10) || '## Root Cause Analysis', '- Hypothesis: ' || CASE WHEN anomaly_id % 7 <> 0 THEN 'Driven by ' || o_orderpriority ELSE '' END, '- Analysis Confidence: ' || printf('%.2f', trust),
        chr(10) || '### Primary Drivers:' || chr(10) || array_to_string(list_transform(drivers[1:5], lambda d: '  - ' || d.segment || ': ' || printf('%.1f', d.contribution) || '% contribution (baseline ratio: ' || printf('%.2f', d.ratio) || ')'), chr(10)),
        CASE WHEN anomaly_id % 5 <> 0 THEN chr(10) || '### Correlated Metrics:' || chr(10) || array_to_string(list_transform([('net_revenue', (ck % 200 - 100) / 100), ('order_lines', ck % 7 / 8), ('discount', ck % 11 / 16)],
          lambda x: '  - ' || x[1] || ': correlation=' || printf('%.3f', x[2]) || ', p-value=' || printf('%.4f', ck % 50 / 1000)), chr(10)) END,
        CASE WHEN anomaly_id % 4 = 1 THEN chr(10) || '### Change Point: Detected at ' || strftime(at_time, '%Y-%m-%d') || chr(10) || '  - Confidence: ' || printf('%.2f', anomaly_id % 100 / 100) || chr(10) || '  - Before mean: '
          || {AMOUNT.format("value / 2")} || ', After mean: ' || {AMOUNT.format("value")} END,
        CASE WHEN anomaly_id % 6 = 0 THEN chr(10) || '## Business Context (from knowledge base):' || chr(10) || '  [' || printf('%.2f', anomaly_id % 100 / 100) || '] Prices rose in spring.' END,
        chr(10) || 'Audience: business stakeholders. ' || CASE WHEN anomaly_id % 13 <> 0 THEN 'Include actionable recommendations.' ELSE '' END) AS prompt FROM f""",
    "x27_context_query": f"""WITH {FOUND} SELECT anomaly_id, concat_ws(' ', CASE WHEN anomaly_id % 17 <> 0 THEN 'metric: ' || metric END,
        CASE WHEN anomaly_id % 2 = 0 THEN 'order_status: ' || o_orderstatus || ' priority: ' || o_orderpriority END, 'type: ' || kind, CASE WHEN anomaly_id % 3 = 0 THEN 'Why did it change?' END) AS query FROM f""",
    "x24_recommendations": r"""WITH c AS (SELECT conv_id, turn, 'Intro - not an item here' || chr(10) || 'Next steps:' || chr(10) || '1. check the upstream feed' || chr(10) || '- short' || chr(10) || text || chr(10)
          || '* call the owner of the data' || chr(10) || '**Notes**' || chr(10) || '- not an item either' || chr(10) || '**- an item after no opening line' AS t FROM conversations),
        l AS (SELECT conv_id, turn, i, regexp_replace(string_split(t, chr(10))[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT *, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM c)),
        m AS (SELECT *, CASE WHEN regexp_matches(lower(line), 'recommendation|next step|action') THEN true WHEN starts_with(line, '**') AND NOT starts_with(line, '**-') THEN false END AS mark FROM l),
        s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside, trim(regexp_replace(line, '^[0-9.\-•*) ]+', '')) AS item FROM m),
        k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM s WHERE inside AND mark IS NULL AND length(item) > 10)
        SELECT conv_id, turn, coalesce(string_agg(item, '|' ORDER BY i) FILTER (n <= 5), '') AS items FROM (SELECT DISTINCT conv_id, turn FROM c) LEFT JOIN k USING (conv_id, turn) GROUP BY 1, 2""",
    "o09_usage": """SELECT count(*) AS total, count(*) FILTER (event_type <> 'error' AND event_id % 3 <> 0) AS answered, count(*) FILTER (event_type <> 'error' AND event_id % 3 = 0) AS fallbacks,
        count(*) FILTER (event_type = 'error') AS errors, CAST(sum(event_id % 500) AS BIGINT) AS tokens, round(avg(value), 2) AS mean_millis FROM events""",
    "m14_percent_deviation": f"WITH {FOUND} SELECT anomaly_id, round(100 * (value - expected) / abs(expected), 6) AS pct FROM f",
    "m13_figure_class": """SELECT p_partkey, CASE WHEN p_partkey % 60 > 45 THEN 'Technical Schematic / Architectural Diagram / Flowchart' WHEN p_partkey % 60 > 15 THEN 'Chart / Graph / Data Plot'
        ELSE 'Photographic Image / Illustration' END AS kind, CASE WHEN p_partkey % 23 = 0 THEN '1:1 (Square)' WHEN p_size / (p_partkey % 23) > 1.3 THEN printf('%.1f', p_size / (p_partkey % 23)) || ':1 (Landscape)'
        WHEN p_size / (p_partkey % 23) < 0.77 THEN '1:' || printf('%.1f', 1 / (p_size / (p_partkey % 23))) || ' (Portrait)' ELSE printf('%.2f', p_size / (p_partkey % 23)) || ':1 (Standard)' END AS aspect FROM part""",
    "g09_hourly_stream": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "g04_feedback_stream": """SELECT 'c' || (user_id % 40) AS key, CAST(round(sum(CASE WHEN event_type = 'purchase' THEN 0.12 ELSE -0.15 END), 3) AS DOUBLE) AS weight
        FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1""",
    "g02_rate_limit": """WITH RECURSIVE q AS (SELECT user_id % 20 AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts) AS n FROM events WHERE ts IS NOT NULL),
        r AS (SELECT key, 0 AS n, CAST([] AS DOUBLE[]) AS times, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS BOOLEAN) AS allowed, CAST(NULL AS DOUBLE) AS retry_after FROM (SELECT DISTINCT key FROM q)
          UNION ALL SELECT key, n, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, t, len(live) < 3, CASE WHEN len(live) < 3 THEN 0.0 ELSE live[1] + 3600 - t END
          FROM (SELECT q.key, q.n, q.t, list_filter(r.times, lambda x: x > q.t - 3600) AS live FROM r JOIN q ON q.key = r.key AND q.n = r.n + 1))
        SELECT key, round(t, 3) AS "at", allowed, round(retry_after, 3) AS retry_after FROM r WHERE n > 0""",
    "g03_task_stream": """WITH u AS (SELECT user_id AS task_id, event_id AS seq, event_id % 5 AS step, 'stage ' || event_type AS stage, event_id * 7 % 120 AS progress,
          CASE WHEN event_type = 'purchase' AND event_id % 53 = 0 THEN 'completed' WHEN event_type = 'error' AND event_id % 31 = 0 THEN 'failed' ELSE 'processing' END AS status FROM events),
        e AS (SELECT task_id, min(seq) FILTER (status <> 'processing') AS first_end, max(seq) FILTER (status <> 'processing') AS last_end,
          max(seq) FILTER (status = 'completed') AS completed FROM u GROUP BY 1),
        b AS (SELECT task_id, max(least(progress, 99)) AS progress, arg_max(step, seq) AS step, arg_max(stage, seq) AS stage
          FROM u JOIN e USING (task_id) WHERE status = 'processing' AND seq < coalesce(first_end, 9e18) GROUP BY 1),
        f AS (SELECT task_id, arg_max(stage, seq) FILTER (seq % 2 = 0) AS named, max(seq) AS last FROM u JOIN e USING (task_id)
          WHERE status = 'failed' AND seq > coalesce(completed, -1) GROUP BY 1)
        SELECT e.task_id, CASE WHEN last_end IS NULL THEN 'processing' WHEN completed = last_end THEN 'completed' ELSE 'failed' END AS status,
          CAST(CASE WHEN completed IS NOT NULL THEN 5 ELSE coalesce(b.step, 0) END AS INTEGER) AS step,
          coalesce(f.named, CASE WHEN completed IS NOT NULL THEN 'Complete' ELSE coalesce(b.stage, '') END) AS stage,
          CAST(CASE WHEN completed IS NOT NULL THEN 100 ELSE coalesce(b.progress, 0) END AS INTEGER) AS progress,
          CASE WHEN last_end IS NOT NULL AND completed IS DISTINCT FROM last_end THEN 'broke at ' || last_end END AS error
        FROM e LEFT JOIN b USING (task_id) LEFT JOIN f USING (task_id)""",
    "g03_task_states": """SELECT user_id % 50 AS task_id, ['queued', 'running', 'indexing', 'failed'][max(event_id % 4) + 1] AS status, max(event_id % 100) AS progress FROM events GROUP BY 1""",
}
