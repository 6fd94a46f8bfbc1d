"""Sketch profiles, encodings, file checks, the upload gate, reported ranges, index streams, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality, retrieval, series, sketches
from ..operators.quantiles import percentiles
from ..sources import tables as src
from ..sources.snapshots import Table
from ..sources.tables import load
from ..streaming import jobs
from . import detection
from . import tables as table_plans
from .files import new_folder

PROFILED = ["l_quantity", "l_extendedprice", "l_linestatus", "l_partkey"]
QUANTILES = (0.25, 0.5, 0.75)


def profiled(spark, sf_dir, merged: bool = False):
    """lineitem by return flag, or as a whole from the flags' sketches; estimates are compared with exact figures, within four times their stated error."""
    li = load(spark, sf_dir, "lineitem").withColumn("l_quantity", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity")))
    by = [] if merged else ["l_returnflag"]
    parts = sketches.sketch(li, PROFILED, ["l_returnflag"])
    est = sketches.estimates(sketches.merge(parts) if merged else parts, QUANTILES)
    texts = ["l_linestatus"]
    exact = percentiles(li, [c for c in PROFILED if c not in texts], (0.21, 0.46, 0.71, 0.29, 0.54, 0.79), by)
    exact = exact.select(*by, "column", F.col("distinct").alias("exact"), F.slice("at", 1, 3).alias("low"), F.slice("at", 4, 3).alias("high"))
    for c in texts:
        different = li.where(F.col(c).isNotNull()).select(*by, c).distinct().groupBy(*by).agg(F.count("*").alias("exact"))
        exact = exact.unionByName(different.withColumn("column", F.lit(c)), allowMissingColumns=True)
    rows = est.join(exact, [*by, "column"], "left").withColumn("exact", F.coalesce("exact", F.lit(0)))  # a column without values has none
    near = F.abs(F.col("distinct") - F.col("exact")) <= 4 * sketches.DISTINCT_ERROR * F.col("exact") + 1
    inside = F.forall(F.arrays_zip("quantiles", "low", "high"), lambda x: (x["quantiles"] >= x["low"]) & (x["quantiles"] <= x["high"]))
    return rows.select(*by, "column", "n", "nulls", "least", "greatest", near.alias("distinct_near"), F.coalesce(inside, F.lit(True)).alias("quantiles_near"))


def sampled(spark, sf_dir):
    """Five values of each column by least hash: how many, and whether all of them are values of the column."""
    li = load(spark, sf_dir, "lineitem")
    columns = ["l_linestatus", "l_partkey", "l_returnflag"]
    distinct = sketches.estimates(sketches.sketch(li, columns)).select("column", "distinct")
    found = sketches.sample_values(li, columns, {r["column"]: r["distinct"] for r in distinct.collect()})
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    known = li.select(F.inline(cells)).distinct()
    rows = found.select("column", F.explode("values").alias("value")).join(known.withColumn("known", F.lit(1)), ["column", "value"], "left")
    return rows.groupBy("column").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct"), F.count("known").alias("known"))


ENCODED = {"UTF-8": " déjà — Москва", "windows-1252": " déjà été — forêt", "windows-1251": " Москва город", "UTF-8 plain": " Paris"}


def encodings(spark, sf_dir):
    """Customers written in several encodings, found out and read again."""
    out = []
    for name, words in ENCODED.items():
        path = f"{new_folder(spark, 'encoded')}.csv"
        rows = load(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(words)).alias("c_name"))
        src.allow_encoding(spark, name.split(" ")[0])
        rows.write.option("header", True).option("encoding", name.split(" ")[0]).csv(path)
        found = src.detect_encoding(spark, path)
        back = src.read_delimited(spark, path, "c_custkey long, c_name string", encoding=found)
        out.append(back.select(F.lit(found).alias("encoding"), "c_custkey", "c_name"))
    return reduce(DataFrame.unionByName, out)


def structure(spark, sf_dir):
    """What is wrong with three files made from customers."""
    c = load(spark, sf_dir, "customer")
    files = {
        "sound": c.select("c_custkey", "c_name"), "empty column": c.select("c_custkey", F.lit(None).cast("string").alias("c_note"), "c_name"),
    }
    out = []
    for name, df in files.items():
        path = f"{new_folder(spark, 'checked')}.csv"
        df.coalesce(1).write.option("header", True).csv(path)
        out += [(name, problem) for problem in src.check_structure(spark, path) or ["none"]]
    path = f"{new_folder(spark, 'checked')}.csv"
    lines = spark.createDataFrame([("c_custkey,c_custkey",)], "line string").union(c.select(F.concat_ws(",", "c_custkey", "c_name")))
    lines.coalesce(1).write.text(path)
    out += [("repeated name", problem) for problem in src.check_structure(spark, path)]
    return spark.createDataFrame(out, "file string, problem string")


def files_of(spark, sf_dir):
    """Folders of text files by segment, listed: how many of each suffix, with text in them."""
    path = new_folder(spark, "listed")
    for suffix, market in (("txt", "BUILDING"), ("md", "MACHINERY"), ("xyz", "FURNITURE")):
        load(spark, sf_dir, "customer").where(F.col("c_mktsegment") == market).select("c_name").coalesce(1).write.text(f"{path}/{suffix}/deep")
    # the writer names all its files .txt: the folder says what they were
    rows = src.list_files(spark, path).where("length > 0")
    return rows.groupBy(F.element_at(F.split("path", "/"), -3).alias("folder"), "suffix").agg(F.count("*").alias("n"))


def gated(spark, sf_dir):
    """Documents as uploads: some of a type that is not taken, without content, empty or too large."""
    d = load(spark, sf_dir, "documents")
    suffix = F.when(F.col("doc_id") % 31 == 3, "exe").when(F.col("doc_id") % 31 != 5, F.element_at(F.array(F.lit("txt"), F.lit("PDF"), F.lit("md")), (F.col("doc_id") % 3 + 1).cast("int")))
    text = F.when(F.col("doc_id") % 17 == 1, "").when(F.col("doc_id") % 17 != 2, F.col("text"))
    rows = src.upload_gate(d.select("doc_id", text.alias("text"), suffix.alias("suffix")), "doc_id", "text", F.col("suffix"), 4000)
    return rows.select("doc_id", "status", "sha256", "bytes", "error", F.col("completed_at").isNotNull().alias("is_completed"))


def reported(spark, sf_dir):
    """Order figures as results with limits, some of them beyond."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(
        k.alias("id"), (k * 7 % 10300 / 97.0).alias("contribution"), (k % 2101 / 1000.0 - 1.05).alias("correlation"), (k % 997 / 990.0).alias("p_value"),
        (k % 1013 / 1000.0 - 0.005).alias("confidence"), (k % 13 * 1.00005).alias("expected_min"), (k % 17 * 1.00005 + 3).alias("expected_max"),
    )
    return quality.checked(rows).withColumn("invalid", F.array_join("invalid", "|"))


def index_stream(spark, sf_dir):
    """Documents streamed into an index twice, the second time without a change, then rolled back and added again."""
    folder = new_folder(spark, "streamed-index")
    load(spark, sf_dir, "documents").select("doc_id", "source").repartition(6).write.parquet(f"{folder}/in")
    t = Table(spark, f"{folder}/index")
    for _ in range(2):
        jobs.run_once(jobs.read_table(spark, f"{folder}/in", 2), t.sink("documents"), f"{folder}/check")
    t.roll_back(0)
    jobs.run_once(jobs.read_table(spark, f"{folder}/in", 2), t.sink("documents"), f"{folder}/check-again")
    return t.read().groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def index_report(spark, sf_dir):
    """Counts of an index and of its files."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("org_id"))
    path = new_folder(spark, "reported-index")
    d.coalesce(1).write.parquet(path)
    listed = src.list_files(spark, path, ("parquet",)).agg(F.count_if(F.col("length") > 0).alias("files"), F.lit(1).alias("_one"))
    return retrieval.index_stats(spark.read.parquet(path)).withColumn("_one", F.lit(1)).join(listed, "_one").drop("_one")  # two single rows


def aligned(spark, sf_dir):
    """Hourly series joined with their groups, which some hours lack; what is left takes part in contextual detection."""
    s = detection.hourly(spark, sf_dir)
    groups = s.where("idx % 5 <> 2").select("key", "idx", F.when(F.col("idx") % 11 != 3, F.col("idx") % 24).alias("grp"))
    return series.aligned(s.withColumn("v", F.when(F.col("idx") % 13 != 6, F.col("v"))), groups).select("key", "idx", "v", "grp")


QUERIES = {
    "a23_sketch_profile": profiled,
    "a23_merged_sketches": lambda sp, d: profiled(sp, d, True),
    "a23_sample_values": sampled,
    "s03_encodings": encodings,
    "s05_structure": structure,
    "s06_list_files": files_of,
    "o03_upload_gate": gated,
    "o26_reported_ranges": reported,
    "m15_quality_scores": lambda sp, d: quality.scores(quality.quality_metrics(table_plans.plain(sp, d)), quality.validate(table_plans.plain(sp, d), table_plans.RULES)),
    "g06_index_stream": index_stream,
    "o15_index_report": index_report,
    "j05_aligned_groups": aligned,
}


def _profile_sql(by: str) -> str:
    parts = []
    for c in PROFILED:
        v = "CASE WHEN l_orderkey % 9 <> 0 THEN l_quantity END" if c == "l_quantity" else c
        ends = f"CAST(min({v}) AS DOUBLE) AS least, CAST(max({v}) AS DOUBLE) AS greatest" if c != "l_linestatus" else "CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS greatest"
        parts.append(f"SELECT {by}'{c}' AS \"column\", count(*) AS n, count(*) - count({v}) AS nulls, {ends}, true AS distinct_near, true AS quantiles_near FROM lineitem GROUP BY ALL")
    return " UNION ALL ".join(parts)


SQL = {
    "a23_sketch_profile": _profile_sql("l_returnflag, "),
    "a23_merged_sketches": _profile_sql(""),
    "a23_sample_values": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", least(5, count(DISTINCT {c})) AS n, least(5, count(DISTINCT {c})) AS distinct, least(5, count(DISTINCT {c})) AS known FROM lineitem" for c in ("l_linestatus", "l_partkey", "l_returnflag")),
    "s03_encodings": " UNION ALL ".join(f"SELECT '{name.split(' ')[0]}' AS encoding, c_custkey, c_name || '{words}' AS c_name FROM customer" for name, words in ENCODED.items()),
    "s05_structure": "SELECT * FROM (VALUES ('sound', 'none'), ('empty column', 'column has no value: c_note'), ('repeated name', 'column name occurs twice: c_custkey')) t(file, problem)",
    "s06_list_files": """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'txt' WHEN 'MACHINERY' THEN 'md' ELSE 'xyz' END AS folder, 'txt' AS suffix, 1 AS n FROM customer
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY c_mktsegment""",
    "o03_upload_gate": """WITH u AS (SELECT doc_id, CASE WHEN doc_id % 17 = 1 THEN '' WHEN doc_id % 17 <> 2 THEN text END AS t, CASE WHEN doc_id % 31 = 3 THEN 'exe' WHEN doc_id % 31 <> 5 THEN 'ok' END AS s FROM documents),
        e AS (SELECT *, strlen(t) AS bytes, CASE WHEN s = 'exe' THEN 'unsupported type: exe' WHEN s IS NULL THEN 'unsupported type: none' WHEN t IS NULL THEN 'no content' WHEN t = '' THEN 'file is empty'
          WHEN strlen(t) > 4000 THEN 'larger than 4000 bytes' END AS error FROM u)
        SELECT doc_id, CASE WHEN error IS NULL THEN 'pending' ELSE 'failed' END AS status, CASE WHEN error IS NULL THEN sha256(t) END AS sha256, bytes, error, error IS NOT NULL AS is_completed FROM e""",
    "o26_reported_ranges": """WITH r AS (SELECT o_orderkey AS id, round(o_orderkey * 7 % 10300 / 97.0, 2) AS contribution, round(o_orderkey % 2101 / 1000.0 - 1.05, 3) AS correlation, round(o_orderkey % 997 / 990.0, 4) AS p_value,
          round(o_orderkey % 1013 / 1000.0 - 0.005, 3) AS confidence, round(o_orderkey % 13 * CAST(1.00005 AS DOUBLE), 4) AS expected_min, round(o_orderkey % 17 * CAST(1.00005 AS DOUBLE) + 3, 4) AS expected_max FROM orders)
        SELECT *, array_to_string(list_filter([CASE WHEN contribution NOT BETWEEN 0 AND 100 THEN 'contribution' END, CASE WHEN correlation NOT BETWEEN -1 AND 1 THEN 'correlation' END,
          CASE WHEN p_value NOT BETWEEN 0 AND 1 THEN 'p_value' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END,
          CASE WHEN expected_min > expected_max THEN 'expected_min, expected_max' END], lambda x: x IS NOT NULL), '|') AS invalid FROM r""",
    "m15_quality_scores": f"""SELECT round(missing_percent / 100, 4) AS stored_score, (SELECT round(avg(CAST(passed AS DOUBLE)), 4) FROM ({table_plans.SQL["a11_validation_rules"]})) AS pass_ratio
        FROM ({table_plans.SQL["a10_quality_metrics"]})""",
    "g06_index_stream": "SELECT source, count(*) AS n, count(DISTINCT doc_id) AS documents FROM documents GROUP BY 1",
    "o15_index_report": "SELECT count(*) AS vectors, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS orgs, 1 AS files FROM documents",
    "j05_aligned_groups": f"WITH {detection.S} SELECT key, idx, v, idx % 24 AS grp FROM s WHERE idx % 5 <> 2 AND idx % 11 <> 3 AND idx % 13 <> 6",
}
