"""Scans: Parquet tables, delimited files, text, JSON, directories, metadata."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encoding import encoding_of

PROBE_BYTES = 10_000
SPARK_ENCODINGS = ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")
MAX_DELIMITED_BYTES = 500 * 2**20
MAX_DOCUMENT_BYTES = 50 * 2**20
#: Suffixes that the document scan takes.
DOCUMENT_SUFFIXES = ("txt", "md", "csv", "json", "pdf", "docx", "png", "jpg", "jpeg", "log", "rst", "html", "xml")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lakesignal.shared.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lakesignal-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
        spark.conf.set("lakesignal.shared.dir", shared)
    return shared.rstrip("/")


def separator_of(path: str) -> str:
    return "\t" if path.lower().endswith((".tsv", ".tsv.gz")) else ","


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of a file (of a folder, of one of its files) by the statistics of its first PROBE_BYTES."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, PROBE_BYTES)).head()
    return encoding_of(bytes(head[0] or b"")) if head else "UTF-8"


def allow_encoding(spark: SparkSession, name: str) -> None:
    """Let the session read and write an encoding of Java's that Spark refuses by default; the few it knows change nothing."""
    if name.upper() not in SPARK_ENCODINGS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    time_column: str | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """CSV or TSV by suffix, with a header; NaN counts as null, the time column is parsed with coercion.

    Without a schema every column is a string: infer types with profile.infer_types and read again.
    """
    reader = spark.read.option("header", True).option("sep", separator_of(path)).option("quote", '"').option("escape", '"')
    encoding = encoding or detect_encoding(spark, path)
    allow_encoding(spark, encoding)
    reader = reader.option("encoding", encoding).option("multiLine", encoding.startswith("UTF-16"))
    df = (reader.schema(schema) if schema else reader).csv(path)
    nan = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in nan})
    return df.withColumn(time_column, F.try_to_timestamp(F.col(time_column).cast("string"))) if time_column else df


def check_structure(spark: SparkSession, path: str, rows: int = 100) -> list[str]:
    """What is wrong with a delimited file: empty, header names twice, columns without a value in its first rows."""
    lines = spark.read.text(path).limit(1).collect()
    if not lines or not lines[0][0].strip():
        return ["file is empty"]
    names = [n.strip().strip('"') for n in lines[0][0].split(separator_of(path))]
    found = [f"column name occurs twice: {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    if found:
        return found
    head = read_delimited(spark, path).limit(rows)
    known = head.agg(F.count("*").alias("*"), *(F.count(F.col(f"`{c}`")).alias(c) for c in head.columns)).first()
    if not known["*"]:
        return ["no data rows"]
    return [f"column has no value: {c}" for c in head.columns if not known[c]]


def list_files(spark: SparkSession, path: str, suffixes=DOCUMENT_SUFFIXES, recursive: bool = True, most: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """(path, name, suffix, length, modified) of a folder's files by suffix, up to a size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(
        "path",
        name.alias("name"),
        F.lower(F.element_at(F.split(name, r"\."), -1)).alias("suffix"),
        "length",
        F.col("modificationTime").alias("modified"),
    )
    return out.where(F.col("suffix").isin(*suffixes) & (F.col("length") <= most))


def read_documents(spark: SparkSession, path: str, suffix: str = "txt") -> DataFrame:
    """(path, content, sha256) of text files: UTF-8, else Latin-1; markup stays as it is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path)
    raw = F.col("content")
    text = F.try_validate_utf8(raw.cast("string"))
    return files.select("path", F.coalesce(text, F.decode(raw, "ISO-8859-1")).alias("content"), F.sha2(raw, 256).alias("sha256"))


def pretty_json(text: Column) -> Column:
    """Valid JSON normalised; anything else as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def rows_as_text(df: DataFrame, order: list[str], columns: list[str] | None = None, most: int = 500) -> DataFrame:
    """(n, line): a headers line, then 'Row i: name: value; ...' of the first rows, empty cells left out."""
    columns = columns or df.columns
    first = df.orderBy(*order).limit(most)
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(*order))
    cells = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    rows = first.select(n.alias("n"), F.concat(F.lit("Row "), n.cast("string"), F.lit(": "), F.concat_ws("; ", *cells)).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "Headers: " + ", ".join(columns))], "n int, line string")
    return head.union(rows)


def admit_documents(docs: DataFrame, id_col: str, text_col: str, most: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """(id, sha256, bytes) of texts that are present and not too long."""
    size = F.octet_length(text_col).cast("long")
    return docs.where(F.col(text_col).isNotNull() & (size <= most)).select(id_col, F.sha2(F.col(text_col), 256).alias("sha256"), size.alias("bytes"))


def upload_gate(docs: DataFrame, id_col: str, text_col: str, suffix: Column, most: int = MAX_DOCUMENT_BYTES, at: Column | None = None) -> DataFrame:
    """(id, status, sha256, bytes, error, completed_at): every upload, admitted ones as 'pending' with their hash, others as 'failed' with the reason.

    Checked in this order: a known suffix, a content, one that is not empty, its
    size. Failed rows are the records that a run log keeps; repeated ids are uploads each.
    """
    size = F.octet_length(text_col).cast("long")
    error = (
        F.when(~F.coalesce(F.lower(suffix).isin(*DOCUMENT_SUFFIXES), F.lit(False)), F.concat(F.lit("unsupported type: "), F.coalesce(suffix, F.lit("none"))))
        .when(F.col(text_col).isNull(), "no content")
        .when(size == 0, "file is empty")
        .when(size > most, F.concat(F.lit("larger than "), F.lit(str(most)), F.lit(" bytes")))
    )
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), error.alias("error"), size.alias("bytes"))
    failed = F.col("error").isNotNull()
    return rows.select(
        id_col, F.when(failed, "failed").otherwise("pending").alias("status"), F.when(~failed, F.sha2("_text", 256)).alias("sha256"), "bytes", "error",
        F.when(failed, F.current_timestamp() if at is None else at).alias("completed_at"),
    )
