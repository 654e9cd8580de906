"""A content-addressed WARC archive: payloads once by digest, record headers apart, records joined together again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.storage import new_path

#: Payloads from this size on are written once; later records of the same payload are revisits.
REVISIT_BYTES = 100
#: Payloads of more records than this are joined from a broadcast table, if all of these are of no more bytes than that.
HOT, HOT_BYTES = 10_000, 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """``headers(page_id, digest, payload_bytes, warc_header, http_header)``, ``payloads(digest, copies, payload_bytes,
    payload)``: two tables in the same buckets of digests, so that they meet without a shuffle."""

    headers: DataFrame
    payloads: DataFrame


def _record_id(page_id: str, digest: str) -> str:
    """A stable record id for a page and payload, in UUID form."""
    h = f"md5(concat(coalesce(string({page_id}), ''), ' ', {digest}))"
    parts = ", '-', ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat('<urn:uuid:', {parts}, '>')"


def write_archive(
    pages: DataFrame,
    page_id: Column,
    url: Column,
    payload: Column,
    date: str = "1970-01-01T00:00:00Z",
    path: str | None = None,
) -> Archive:
    """Archive one record per row under ``path`` (by default a new one in the shared folder).

    Of records with equal payloads of ``REVISIT_BYTES`` or more, those with the smallest id are responses and the others
    revisits that refer to it; smaller payloads are responses always. Each distinct payload is stored once, under its
    SHA-256. Line breaks in an address are percent-coded, as a header line cannot hold them.

    A null payload is empty. Rows that repeat the smallest id are responses like it; null ids come last, and if a payload
    has only null ids, all its records are responses. No rows give an empty archive.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = pages.select(page_id.alias("page_id"), url.cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload", F.coalesce(F.encode(F.col("payload").cast("string"), "UTF-8"), F.lit(b"")))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    sized = rows.select("page_id", "url", "digest", F.length("payload").cast("bigint").alias("payload_bytes"))
    firsts = sized.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    revisit = f"payload_bytes >= {REVISIT_BYTES} and not (page_id <=> first_id)"
    http = "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', payload_bytes, '\\r\\n\\r\\n')"
    head = f"""concat(
        'WARC/1.1\\r\\nWARC-Type: ', if({revisit}, 'revisit', 'response'),
        '\\r\\nWARC-Record-ID: ', {_record_id("page_id", "digest")},
        '\\r\\nWARC-Date: {date}',
        '\\r\\nWARC-Target-URI: ', replace(replace(coalesce(url, ''), '\\r', '%0D'), '\\n', '%0A'),
        '\\r\\nWARC-Payload-Digest: sha256:', digest,
        if({revisit}, concat('\\r\\nWARC-Profile: {PROFILE}\\r\\nWARC-Refers-To: ', {_record_id("first_id", "digest")},
            '\\r\\nX-Refers-To-Page: ', first_id), ''),
        '\\r\\nContent-Type: application/http; msgtype=response\\r\\nContent-Length: ',
        length(http_header) + if({revisit}, 0, payload_bytes), '\\r\\n\\r\\n')"""
    headers = (
        sized.join(firsts, "digest")
        .selectExpr("*", f"{http} http_header")
        .selectExpr("page_id", "digest", "payload_bytes", f"{head} warc_header", "http_header")
    )
    payloads = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.length(F.first("payload")).cast("bigint").alias("payload_bytes"), F.first("payload").alias("payload")
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, table in (("headers", headers.repartition(buckets, "digest")), ("payloads", payloads)):
        # Rows come spread by digest over as many tasks as there are buckets, so a bucket is one file.
        writer = table.write.bucketBy(buckets, "digest").option("path", f"{path}/{name}").mode("overwrite")
        writer.saveAsTable(_table_name())
    layout = [(buckets, headers.schema["page_id"].dataType.simpleString())]
    spark.createDataFrame(layout, "buckets int, id_type string").write.mode("overwrite").parquet(f"{path}/layout")
    return open_archive(spark, path)


def _table_name() -> str:
    return f"warc_{uuid.uuid4().hex}"


_TABLES = {
    "headers": "page_id {}, digest string, payload_bytes bigint, warc_header string, http_header string",
    "payloads": "digest string, copies bigint, payload_bytes bigint, payload binary",
}


def open_archive(spark: SparkSession, path: str) -> Archive:
    """The archive under ``path``. Its tables are named in the session's catalog, which is how Spark knows their buckets."""
    buckets, id_type = spark.read.parquet(f"{path}/layout").first()
    found = {}
    for name, columns in _TABLES.items():
        table = _table_name()
        spark.sql(
            f"CREATE TABLE {table} ({columns.format(id_type)}) USING parquet "
            f"CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/{name}'"
        )
        found[name] = spark.table(table)
    return Archive(**found)


def read_records(archive: Archive) -> DataFrame:
    """``(page_id, head_bytes, record, payload)``: each record's exact bytes, and the payload it stands for.

    The payload is verified against the digest it is stored under, and its size against the header; a difference fails
    the job. A revisit's record ends with its HTTP headers, as the standard has it; its payload comes from the store.
    """
    checked = archive.payloads.select(
        "digest",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest")).cast("binary"))
        .alias("payload"),
    )
    joined = archive.headers.join(checked, "digest", "left")
    hot = archive.payloads.where(F.col("copies") > HOT)
    if 0 < (hot.agg(F.sum("payload_bytes")).first()[0] or 0) <= HOT_BYTES:
        # A bucket with a payload of very many records would be one long task: those records stay where they are.
        known = F.broadcast(hot.select("digest"))
        alike = archive.headers.join(F.broadcast(checked.join(known, "digest", "left_semi")), "digest")
        joined = archive.headers.join(known, "digest", "left_anti").join(checked, "digest", "left").unionByName(alike)
    whole = F.when(F.length("payload") == F.col("payload_bytes"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload missing or of another size: "), "digest")).cast("binary")
    )
    block = F.when(F.col("warc_header").startswith("WARC/1.1\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    head = F.encode(F.concat("warc_header", "http_header"), "UTF-8")
    return joined.withColumn("payload", whole).select(
        "page_id",
        F.octet_length("warc_header").alias("head_bytes"),
        F.concat(head, block, F.lit(b"\r\n\r\n")).alias("record"),
        "payload",
    )


def parse_records(records: DataFrame) -> DataFrame:
    """The fields of ``read_records``: type, digest and the page referred to, from the record's own header lines."""
    field = "nullif(regexp_extract(head, '(?:^|\\\\r\\\\n){0}: ([^\\\\r]*)', 1), '')"
    return records.selectExpr("page_id", "payload", "record", "decode(substr(record, 1, head_bytes), 'UTF-8') head").selectExpr(
        "page_id",
        "bigint(length(payload)) payload_bytes",
        f"substring({field.format('WARC-Payload-Digest')}, 8) payload_digest",
        f"{field.format('WARC-Type')} record_type",
        f"bigint({field.format('X-Refers-To-Page')}) refers_to",
        "bigint(length(record)) record_bytes",
    )
