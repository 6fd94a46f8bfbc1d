"""WARC archives: writing pages as capture records and assembling captures from records.

Every page becomes a request, a response (or revisit) and a metadata record;
request and metadata name the response in WARC-Concurrent-To. Record texts are
built by SQL functions and written by Spark's text writer, so a lost task's
file is never seen half written. Reading splits the archives at the version
line and trusts Content-Length, so a payload may hold any text, that line too.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, settle

CRLF = "\r\n"
MARK = b"WARC/1."
#: Payloads below are always stored whole.
REVISIT_BYTES = 100
FILE_CAPTURES = 50_000
DATE = "2024-01-01T00:00:00Z"

RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("date", pa.string()),
        ("target_uri", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]
)
RECORD_DDL = (
    "record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string,"
    " digest string, payload_bytes long, fields map<string, string>, payload binary"
)


def with_roles(pages: DataFrame, least: int) -> DataFrame:
    """pages (id, url, html) with payload, payload_digest, payload_bytes, copies and first.

    copies counts the rows of the same id and payload, null for one; first
    (id, url, copies) is the page that holds the payload of a revisit, null for a response.
    """
    rows = pages.select("id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("")))
    # Texts stay out of this: ids and digests are counted before the shuffle.
    held = rows.groupBy("key", "payload_digest").agg(
        F.first("id").alias("id"), F.min("url").alias("url"), F.min("payload_bytes").alias("size"), F.count("*").alias("copies")
    )
    named = held.where((F.col("size") >= least) & F.col("id").isNotNull())
    first = named.groupBy("payload_digest").agg(F.min(F.struct("id", "url", "copies")).alias("first"))
    revisit = F.col("first").isNotNull() & (F.col("size") >= least) & (F.col("id").isNull() | (F.col("id") > F.col("first.id")))
    roles = held.join(first, "payload_digest", "left").select(
        "key", "payload_digest", F.when(F.col("copies") > 1, F.col("copies")).alias("copies"), F.when(revisit, F.col("first")).alias("first")
    )
    roles = roles.where("copies is not null or first is not null")
    return rows.join(roles, ["key", "payload_digest"], "left")


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = REVISIT_BYTES,
) -> None:
    """Write a request, a response or revisit, and a metadata record for each row to gzipped archives at path.

    The payload is the html in UTF-8, null as empty. Of pages with equal
    payloads of at least `least` bytes the one with the smallest id is the
    response that the others revisit, also those without an id; rows that share
    that smallest id are all responses, and so are all rows if none has an id.
    Every row has records of its own, repeated ones too. A revisit names its
    response in WARC-Refers-To (left out if that page's row is repeated), its
    url and its date. A null url writes no target; control characters in urls
    are percent-encoded. Payloads may be of any length. Extra columns are
    ignored. An empty table writes no record.
    """
    needed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = with_roles(needed, least)
    rows = rows.withColumn("nth", F.when(F.col("copies") > 1, F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"))).otherwise(""))

    def escaped(url: Column) -> Column:
        for code in (0, 9, 10, 13):
            url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
        return url

    def name_of(key: Column) -> Column:
        return F.concat(F.lit("urn:capture:"), key, F.lit(":"), F.substring("payload_digest", 1, 32))

    url, capture, first = escaped(F.col("url")), F.concat(name_of(F.col("key")), F.col("nth")), F.col("first")
    revisit = first.isNotNull()

    def record(kind: Column, name: str, head: list[Column], block: Column, media: str) -> Column:
        lines = [
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), kind),
            F.concat(F.lit("WARC-Record-ID: <"), capture, F.lit(f":{name}>")),
            F.lit(f"WARC-Date: {DATE}"),
            F.concat(F.lit("WARC-Target-URI: "), url),
            *head,
            F.lit(f"Content-Type: {media}"),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        ]
        return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)

    beside = F.concat(F.lit("WARC-Concurrent-To: <"), capture, F.lit(":response>"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"))
    target = F.regexp_replace(F.regexp_extract(url, "://[^/?#]*([^#]*)", 1), r"^(?!/)", "/")
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    held_by = F.when(revisit & (first["copies"] == 1), F.concat(F.lit("WARC-Refers-To: <"), name_of(first["id"].cast("string")), F.lit(":response>")))
    held_at = F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), escaped(first["url"])))
    request = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF * 2))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    facts = F.concat_ws(
        CRLF,
        F.concat(F.lit("id: "), F.col("id").cast("string")),
        F.concat(F.lit("refers-to-id: "), first["id"].cast("string")),
    )
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    text = F.concat(
        record(F.lit("request"), "request", [beside], request, "application/http;msgtype=request"),
        F.lit(CRLF * 2),
        record(
            F.when(revisit, "revisit").otherwise("response"),
            "response",
            [digest, F.when(revisit, profile), held_by, held_at, F.when(revisit, f"WARC-Refers-To-Date: {DATE}")],
            F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
            "application/http;msgtype=response",
        ),
        F.lit(CRLF * 2),
        record(F.lit("metadata"), "metadata", [beside], F.concat(facts, F.lit(CRLF)), "application/warc-fields"),
        F.lit(CRLF),
    )
    writer = rows.select(text.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip")
    writer.option("maxRecordsPerFile", FILE_CAPTURES).text(path)


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    pairs = (line.partition(b":") for line in lines if line)
    return [(k.decode("utf-8", "replace").strip().lower(), v.decode("utf-8", "replace").strip()) for k, _, v in pairs]


def _parse(text: bytes, head_end: int, keep_payload: bool) -> dict:
    fields = _fields(text[:head_end].split(b"\r\n")[1:])
    named, length = dict(fields), 0
    length = int(named.get("content-length", 0))
    block = text[head_end + 4 : head_end + 4 + length]
    kind, media = named.get("warc-type"), named.get("content-type", "")
    payload, facts, size, digest = block, [], None, None
    if media.startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = dict(_fields(http.split(b"\r\n")[1:])).get("content-length")
    elif media.startswith("application/warc-fields"):
        facts = list(dict(_fields(block.split(b"\r\n"))).items())
    if kind == "revisit":  # the payload is elsewhere; the record states its length and digest
        size = int(size) if size and size.isdigit() else None
        digest = named.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return {
        "record_id": named.get("warc-record-id", "").strip("<>"),
        "type": kind,
        "date": named.get("warc-date"),
        "target_uri": named.get("warc-target-uri"),
        "concurrent_to": [v.strip("<>") for k, v in fields if k == "warc-concurrent-to"],
        "refers_to": named.get("warc-refers-to", "").strip("<>") or None,
        "digest": digest,
        "payload_bytes": size,
        "fields": facts,
        "payload": payload if keep_payload and kind in ("response", "resource") else None,
    }


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row for each record of the gzipped WARC 1.x archives at path.

    payload is filled for responses and resources if asked for; digest is the
    payload's SHA-256, for revisits the one that the record states. Text that
    contains the version line is put together again by Content-Length; an
    archive that ends within a record raises.
    """
    pieces = spark.read.option("lineSep", MARK.decode()).text(path)
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def parse(batches):
        held, head_end, want, at = b"", -1, 0, None
        for b in batches:
            out, size = [], 0
            for text, file in zip(b.column("value").to_pylist(), b.column("file").to_pylist(), strict=True):
                if file != at:
                    if held:
                        raise ValueError(f"{at} ends within a record")
                    at = file
                    if not text:  # what stands before the first record
                        continue
                held = held + MARK + text if held else text
                if head_end < 0:
                    head_end = held.find(b"\r\n\r\n")
                    if head_end < 0:
                        continue
                    lengths = [int(v) for k, v in _fields(held[:head_end].split(b"\r\n")) if k == "content-length"]
                    want = head_end + 4 + (lengths[0] if lengths else 0)
                if len(held) < want:
                    continue
                out.append(_parse(held, head_end, keep_payload))
                size += len(held)
                held, head_end = b"", -1
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, RECORD)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, RECORD)
        if held:
            raise ValueError(f"{at} ends within a record")

    return pieces.mapInArrow(parse, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: response (or revisit, resource), its request and its metadata.

    Records belong together if one names the other in WARC-Concurrent-To,
    whichever does. Of several requests or metadata records, or repeated
    record ids, the first in byte order is kept; a record that belongs to no
    capture gives no row, a capture without request or metadata has nulls there.
    """
    main = F.col("type").isin("response", "revisit", "resource")
    parts = records.columns
    anchors = records.where(main)
    named = records.select("record_id", "type", F.explode("concurrent_to").alias("other"))
    links = (
        named.where(~main).select("record_id", F.col("other").alias("capture"))
        .union(named.where(main).select(F.col("other").alias("record_id"), F.col("record_id").alias("capture")))
        .distinct()
    )
    light = [c for c in parts if c != "payload"]
    beside = records.where(F.col("type").isin("request", "metadata")).select(*light).join(links, "record_id")

    def first(kind: str) -> Column:
        order = F.struct("record_id", "date", "target_uri")
        return F.min_by(F.when(F.col("type") == kind, F.struct(*light)), F.when(F.col("type") == kind, order)).alias(kind)

    beside = beside.groupBy(F.col("capture").alias("record_id")).agg(first("request"), first("metadata"))
    return anchors.dropDuplicates(["record_id"]).join(beside, "record_id", "left").select(
        F.col("record_id").alias("capture_id"), F.struct(*parts).alias("response"), "request", "metadata"
    )


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Write every page to archives in the shared folder, read them back and assemble the captures."""
    from .common import table

    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = settle(read_warc(spark, path, keep_payload=False).drop("payload"), "warc-records")  # the archives are read once
    facts = F.col("metadata.fields")
    return assemble(records).select(
        F.try_element_at(facts, F.lit("id")).cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.try_element_at(facts, F.lit("refers-to-id")).cast("long").alias("refers_to"),
    )


OP5_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
