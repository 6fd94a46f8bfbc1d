"""What the corpus operators share: tables, the shared work folder, let-bindings."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs without ASCII white space (Java pattern of the separators).
SPACES = r"[\x20\x09-\x0D]+"
#: The same six characters, as text.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, and in it one of this application.

    Where it is unset, a local session (tests) gets a temporary folder, which
    is set as the checkpoint folder and removed at exit; on a cluster, whose
    machines would not share it, that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lakesignal.work.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="lakesignal-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        shared = f"file://{local}"
        spark.conf.set("lakesignal.work.dir", shared)
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete what this application's operators have written between their steps; their results must be read by then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a short lineage that outlives executors (see clean)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_words(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits, for text on the driver."""
    return re.findall("[a-z0-9]+", text.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column value, evaluated once a row.

    A filter above a plain withColumn is pushed below it together with the
    expression, which then runs twice, or inside a loop of another expression
    for each element. A generator's output stays where it is.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def labelled(labels: DataFrame, most: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, label) of at most `most` labelled ids, drawn by hash; several labels of an id give their rounded mean.

    Rows with a null id or label take no part.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    rows = rows.groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)
