"""Queries over what sources read back and sinks write, and small column functions, with their SQL."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunker
from ..functions import text as tx
from ..functions.math import clamp01, l2_normalise, norm
from ..operators import quality, records, scoring
from ..sources import sinks
from ..sources.snapshots import Table
from ..sources.tables import load, pretty_json, read_delimited, shared_folder
from . import tables as table_plans
from .detection import SCORED, scored


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def customers(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


SCHEMA = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"


def delimited(spark, sf_dir, suffix: str):
    """Customers written with a header and read again."""
    path = f"{new_folder(spark, 'customers')}.{suffix}"
    customers(spark, sf_dir).write.option("header", True).option("sep", "\t" if suffix == "tsv" else ",").csv(path)
    return read_delimited(spark, path, SCHEMA)


def cleaned_csv(spark, sf_dir):
    path = f"{new_folder(spark, 'cleaned')}.csv"
    for _ in range(2):  # the second run replaces the first
        sinks.write_cleaned(customers(spark, sf_dir), path, "csv")
    return read_delimited(spark, path, SCHEMA).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


def runs(spark, sf_dir):
    """Two runs of which the second has no manifest row."""
    path = new_folder(spark, "runs")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    sinks.write_run({"nations": nations, "regions": load(spark, sf_dir, "region")}, path, "r1")
    nations.write.parquet(f"{path}/nations/run=r2")
    return sinks.read_run(spark, path, "nations").select("n_nationkey", "n_regionkey", "run")


def appended(spark, sf_dir):
    path = new_folder(spark, "log")
    e = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("action"))
    sinks.append_log(e.where("event_id % 2 = 0"), path)
    sinks.append_log(e.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("n"))


def replaced(spark, sf_dir):
    """An index of customers, replaced by one of suppliers; a third version is not complete."""
    path = new_folder(spark, "index")
    keys = lambda t, c: load(spark, sf_dir, t).select(F.col(c).alias("k"))
    sinks.replace_index(keys("customer", "c_custkey"), path, 1)
    sinks.replace_index(keys("supplier", "s_suppkey"), path, 2)
    keys("part", "p_partkey").write.parquet(f"{path}/version=3")
    return sinks.read_index(spark, path)


def snapshots(spark, sf_dir):
    """An index of suppliers and customers through replace, append, a failed append, a repeated batch and a roll back, and a reader that stays on its snapshot."""
    t = Table(spark, new_folder(spark, "snapshots"))
    keys = lambda name, c: load(spark, sf_dir, name).select(F.lit(name).alias("name"), F.col(c).alias("k"))
    t.replace(keys("supplier", "s_suppkey"))
    pinned = t.read()
    t.append(keys("customer", "c_custkey"), stream="s", batch=0)
    t.append(keys("customer", "c_custkey"), stream="s", batch=0)
    try:
        t.append(keys("part", "p_partkey").withColumn("k", F.expr("if(k > 0, raise_error('broken'), k)")))
    except Exception as e:  # the task's error, whichever way it comes
        if "broken" not in str(e):
            raise
    after_failure = t.read()
    t.replace(keys("part", "p_partkey"))
    newest = t.read()
    t.roll_back(1)
    seen = (("pinned", pinned), ("after failure", after_failure), ("newest", newest), ("rolled back", t.read()), ("read as of 2", t.read(2)))
    parts = [df.groupBy("name").agg(F.count("*").alias("n"), F.sum("k").alias("total")).select(F.lit(w).alias("reader"), "name", "n", "total") for w, df in seen]
    return reduce(DataFrame.unionByName, parts)


def chunked(spark, sf_dir):
    chunker.register(spark)
    load(spark, sf_dir, "documents").createOrReplaceTempView("_texts_to_chunk")
    return spark.sql("SELECT d.doc_id, c.* FROM _texts_to_chunk d, LATERAL chunks(d.text) c")


def zipped(spark, sf_dir):
    """Each order's lines as part=quantity pairs, the first three; and how many parts and suppliers it names in all."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey").alias("x"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    pair = lambda p, q: F.concat(p.cast("string"), F.lit("="), q.cast("int").cast("string"))
    pairs = F.zip_with(F.transform("x", lambda x: x["l_partkey"]), F.transform("x", lambda x: x["l_quantity"]), pair)
    both = F.flatten(F.array(F.transform("x", lambda x: x["l_partkey"]), F.transform("x", lambda x: x["l_suppkey"])))
    return rows.select("l_orderkey", F.array_join(F.slice(pairs, 1, 3), ",").alias("pairs"), F.size(both).alias("named"))


def page_range(spark, sf_dir):
    """Pages 1 to 2 of documents of three pages."""
    d = load(spark, sf_dir, "documents").where("text is not null")
    tagged = F.concat(F.lit("[Page 1]"), "text", F.lit("[Page 2]"), "lang", F.lit("[Page 3]"), "source")
    pages = d.select("doc_id", F.explode(tx.pages_of(tagged)).alias("p")).where("p.page between 1 and 2")
    return pages.select("doc_id", "p.page", F.sha2("p.text", 256).alias("text"))


def shown(spark, sf_dir):
    """Chunks as they are embedded (with a header) and shown (without)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text", "source", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("> "), "text")).alias("display_text"))
    embedded = tx.contextual(F.col("text"), F.col("source"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    return d.select("doc_id", F.sha2(embedded, 256).alias("embedded"), F.sha2(F.coalesce("display_text", "text"), 256).alias("shown"))


def parsed(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    at = F.try_to_timestamp(said)
    return o.groupBy(F.date_format(at, "yyyy").alias("year")).agg(F.count("*").alias("n"))


def normalised(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    unit = e.withColumn("u", l2_normalise(F.col("e")))
    return unit.select("vec_id", F.round(norm(F.col("u")), 6).alias("length"), F.round(clamp01(F.col("u")[0] * 4), 5).alias("clamped"))


QUERIES = {
    "s01_csv_scan": lambda sp, d: delimited(sp, d, "csv"),
    "s02_tsv_scan": lambda sp, d: delimited(sp, d, "tsv"),
    "s10_json_text": lambda sp, d: load(sp, d, "events").select("event_id", pretty_json(F.when(F.col("event_id") % 5 == 0, "no json").otherwise(F.col("props"))).alias("props")),
    "k01_cleaned_csv": cleaned_csv,
    "k03_runs": runs,
    "k04_index_replace": replaced,
    "k04_snapshots": snapshots,
    "k07_append_log": appended,
    "e08_chunk_table_function": chunked,
    "a47_run_stats": lambda sp, d: records.run_stats(load(sp, d, "events").select(F.col("event_type").alias("status"), F.col("value").alias("seconds"))),
    "o04_org_rows": lambda sp, d: records.of_org(load(sp, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("org_id")), "BUILDING"),
    "o18_severity_numbers": lambda sp, d: scored(sp, d).groupBy(scoring.severity_number(F.col("level")).alias("number")).agg(F.count("*").alias("n")),
    "o24_report": lambda sp, d: quality.report(quality.validate(table_plans.plain(sp, d), table_plans.RULES)),
    "r03_dimension_map": lambda sp, d: load(sp, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("late")
    ).select("o_orderkey", F.to_json(records.dimension_map(["status", "late"])).alias("dims")),
    "r07_zip_flatten_first": zipped,
    "t10_page_range": page_range,
    "f15_display_text": shown,
    "d01_parse_times": parsed,
    "m08_l2_normalise": normalised,
}
SQL = {
    "s01_csv_scan": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    "s02_tsv_scan": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    "s10_json_text": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no json' ELSE CAST(json(props) AS VARCHAR) END AS props FROM events",
    "k01_cleaned_csv": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1",
    "k03_runs": "SELECT n_nationkey, n_regionkey, 'r1' AS run FROM nation",
    "k04_index_replace": "SELECT s_suppkey AS k FROM supplier",
    "k04_snapshots": """WITH t AS (SELECT 'supplier' AS name, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer
          UNION ALL SELECT 'part', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part)
        SELECT reader, name, n, total FROM t JOIN (VALUES ('pinned', 'supplier'), ('after failure', 'supplier'), ('after failure', 'customer'), ('newest', 'part'), ('rolled back', 'supplier'),
          ('rolled back', 'customer'), ('read as of 2', 'part')) r(reader, name) USING (name)""",
    "k07_append_log": "SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1",
    "a47_run_stats": "SELECT event_type AS status, count(*) AS runs, round(avg(value), 4) AS mean_seconds, max(value) AS longest FROM events GROUP BY 1",
    "o04_org_rows": "SELECT c_custkey, c_mktsegment AS org_id FROM customer WHERE c_mktsegment = 'BUILDING'",
    "o18_severity_numbers": f"WITH {SCORED} SELECT CASE level WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END AS number, count(*) AS n FROM scored GROUP BY 1",
    "o24_report": f"""WITH r AS ({table_plans.SQL['a11_validation_rules']}) SELECT count(*) AS rules, count(*) FILTER (NOT passed) AS failed,
        count(*) FILTER (NOT passed AND severity IN ('high', 'critical')) = 0 AS passed, count(*) FILTER (NOT passed AND severity IN ('low', 'medium')) > 0 AS has_warnings FROM r""",
    "r03_dimension_map": """SELECT o_orderkey, '{"status":"' || o_orderstatus || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"late":"' || o_orderpriority || '"' ELSE '' END || '}' AS dims FROM orders""",
    "r07_zip_flatten_first": """SELECT l_orderkey, array_to_string(list(l_partkey || '=' || CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey)[1:3], ',') AS pairs,
        CAST(2 * count(*) AS INTEGER) AS named FROM lineitem GROUP BY 1""",
    "t10_page_range": r"""SELECT doc_id, 1 AS page, sha256(trim(text)) AS text FROM documents WHERE length(trim(text)) > 0
        UNION ALL SELECT doc_id, 2, sha256(trim(lang)) FROM documents WHERE text IS NOT NULL AND length(trim(lang)) > 0""",
    "f15_display_text": """SELECT doc_id, sha256('[Document: ' || source || ']' || chr(10) || text) AS embedded, sha256(CASE WHEN doc_id % 3 <> 0 THEN '> ' || text ELSE text END) AS shown FROM documents""",
    "d01_parse_times": "SELECT CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y') END AS year, count(*) AS n FROM orders GROUP BY 1",
    "m08_l2_normalise": """WITH n AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS l FROM embeddings)
        SELECT vec_id, round(l / l, 6) AS length, round(greatest(0.0, least(1.0, a / greatest(l, 1e-12) * 4)), 5) AS clamped FROM n""",
}
