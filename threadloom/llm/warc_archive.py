"""Content-addressed WARC archive.

Two tables: ``payloads`` holds each distinct payload once under its SHA-256, ``headers`` the exact header block of
every record with the SHA-256 of its payload. The first page (least id) of those with equal payloads becomes a
response, the others revisit it; payloads under ``min_revisit_bytes`` are always responses. Reading checks payloads
against their digests and joins them to the responses, one each; revisit records have no block, so copies of a
payload, however many, never meet it.

A record's id names archive, page and row, so ids are unique and a revisit's WARC-Refers-To tells the page.

Null payloads are empty. Null ids sort last and give records without a page in their id. A null URL gives no
WARC-Target-URI; line ends in a URL are written as %0D and %0A. Rows with equal id and payload: one of them is the
response, each of the others revisits its id. An empty table gives empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, shared_dir

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: five hexadecimal digits are twenty bits, four letters."""

    def letters(at: Column) -> Column:
        bits = F.conv(F.substring(digest, at, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(36), F.lit(5)), letters))


def _record_id(archive: str, page_id: Column, row: Column) -> Column:
    return F.concat(F.lit(f"<urn:threadloom:{archive}:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, out: str, min_revisit_bytes: int = 0, warc_date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``payloads`` and ``headers`` below ``out``.

    Only ids, sizes and digests are compared to choose responses; payloads travel once, folded by digest on the map
    side, and never as a group.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    rows.select("sha256", "payload").dropDuplicates(["sha256"]).write.parquet(f"{out}/payloads")
    described = rows.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1"), F.monotonically_increasing_id().alias("row"))
    meta = materialize(described, "warc-meta")  # row numbers must not change between the two uses
    first = meta.groupBy("sha256").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"), F.first("sha1").alias("sha1")).withColumn("digest", base32_of_hex(F.col("sha1")))
    placed = meta.drop("sha1").join(first, "sha256").withColumn("is_first", F.col("first.row") == F.col("row"))
    revisit = ~F.col("is_first") & (F.col("payload_bytes") >= min_revisit_bytes)
    archive = uuid.uuid4().hex
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(archive, F.col("page_id"), F.col("row"))),
        line("WARC-Date", F.lit(warc_date)),
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _record_id(archive, F.col("first.page_id"), F.col("first.row"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    placed.select("page_id", "sha256", revisit.alias("revisit"), F.encode(header, "UTF-8").alias("header")).write.parquet(f"{out}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records: page_id, sha256, header (bytes), payload (null for a revisit). Bytes that do not have their digest fail
    the job."""
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("sha256")))))
    headers = spark.read.parquet(f"{path}/headers")
    responses = headers.where("not revisit").join(sound, "sha256").select("page_id", "sha256", "header", "payload")
    return responses.unionByName(headers.where("revisit").select("page_id", "sha256", "header", F.lit(None).cast("binary").alias("payload")))


def record_bytes(records: DataFrame) -> DataFrame:
    """``records`` with ``record``: the exact WARC record, header block, block (none for a revisit), closing line ends."""
    return records.withColumn("record", F.concat("header", F.coalesce("payload", F.lit(b"")), F.lit(b"\r\n\r\n")))


def header_field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"(?:^|\n){name}: ([^\r\n]*)", 1)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archive to shared storage, rebuild its records and describe each from what it holds.

    The payload's size and digest are taken once for each payload, from its response; revisits get them by digest.
    """
    spark = pages.sparkSession
    out = shared_dir(spark, "warc")
    write_archive(pages, out, min_revisit_bytes)
    block = F.substring("record", F.octet_length("header") + 1, header_field("Content-Length").cast("int"))
    named = F.regexp_extract(F.decode("header", "UTF-8"), r"(?:^|\n)WARC-Refers-To: <urn:threadloom:[0-9a-f]+:page:([^\r\n]*):\d+>", 1)
    page = F.when(named != "", named).try_cast(dict(pages.dtypes)["page_id"])
    rebuilt = record_bytes(read_archive(spark, out)).select(
        "page_id", "sha256",
        header_field("WARC-Type").alias("record_type"),
        page.alias("refers_to"),
        F.regexp_replace(header_field("WARC-Payload-Digest"), "^sha1:", "").alias("header_digest"),
        F.when(F.col("payload").isNotNull(), F.octet_length(block).cast("long")).alias("size"),
        F.when(F.col("payload").isNotNull(), base32_of_hex(F.sha1(block))).alias("digest"),
    )
    records = materialize(rebuilt, "warc-records")
    whole = records.where("size is not null").groupBy("sha256").agg(F.first("size").alias("payload_bytes"), F.first("digest").alias("payload_digest"))
    return records.join(whole, "sha256").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "header_digest")
