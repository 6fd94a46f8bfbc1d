"""Sinks: cleaned tables, versioned metadata, run results, event topics, logs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import shared_folder


def steps_folder(spark: SparkSession) -> str:
    """Where this application's operators write what several of their steps read."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-steps"


def clean(spark: SparkSession) -> None:
    """Delete what settle() has written; results that read it must be written by then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(steps_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: a short lineage that outlives executors (see clean)."""
    path = f"{steps_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_cleaned(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def latest_version(log: DataFrame, key: str, version: str, deleted: Column | None = None) -> DataFrame:
    """The current state of an append-only table: each key's newest row, unless that row deletes it."""
    newest = log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version))))
    newest = newest.where("_n = 1").drop("_n")
    return newest.where(~deleted) if deleted is not None else newest


def write_run(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Several tables of one run, then a manifest that makes them visible."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run={run_id}")
    spark = next(iter(tables.values())).sparkSession
    done = spark.createDataFrame([(run_id, sorted(tables))], "run string, tables array<string>")
    done.write.mode("append").parquet(f"{path}/_manifest")


def read_run(spark, path: str, name: str) -> DataFrame:
    """The rows of name of all runs in the manifest."""
    runs = spark.read.parquet(f"{path}/_manifest").select("run").distinct()
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").join(runs, "run", "left_semi")


def replace_index(df: DataFrame, path: str, version: int) -> None:
    """A new version of an index, then the row that makes it the one that readers see; they never meet half of it."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    df.sparkSession.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{path}/_versions")


def read_index(spark, path: str) -> DataFrame:
    """The newest version of an index that is complete."""
    newest = spark.read.parquet(f"{path}/_versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={newest}")


def append_log(rows: DataFrame, path: str) -> None:
    """Audit, feedback and event logs are tables that only grow."""
    rows.write.mode("append").parquet(path)


def event_envelope(rows: DataFrame, event_type: str, at: Column, payload: list[str], id_col: str) -> DataFrame:
    """(event_id, event_type, timestamp, version, payload as JSON)."""
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(event_type), F.col(id_col).cast("string")), 256).alias("event_id"),
        F.lit(event_type).alias("event_type"),
        at.alias("timestamp"),
        F.lit("1.0").alias("version"),
        F.to_json(F.struct(*payload)).alias("payload"),
    )
