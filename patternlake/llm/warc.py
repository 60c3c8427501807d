"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternlake.llm.common import shared_dir

#: Fixed values of the format.
VERSION = "WARC/1.1"
EPOCH = "1970-01-01T00:00:00Z"
EOL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 60 or 40 bits at a time in base 32, whose digits are then renamed."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, address) of each page: address is the payload's SHA-256; null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload")).withColumn("address", F.unhex(F.sha2("payload", 256)))


def record_id(page_id) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as tables ``headers`` (page_id, header, address) and ``payloads`` (address, payload) below ``path``.

    Each distinct payload is stored once: repeats are combined in each task before anything is shuffled. Of records with equal
    payloads of at least ``least`` bytes the one with the largest page_id is a response and the
    others revisit it; shorter payloads are all responses, whose bytes are still stored once. Line ends
    in a url are percent-encoded in the header. Where page_ids are null or repeated every row with the
    largest id is a response, and a null id revisits.
    """
    rows = with_digests(pages)
    rows.groupBy("address").agg(F.first("payload").alias("payload")).write.mode("overwrite").parquet(f"{path}/payloads")
    small = rows.select("page_id", "url", "address", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    # one id for each payload that repeats, from partial counts; the join splits a digest that many share
    keep = rows.groupBy("address").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    small = small.join(keep.select("address", "keeper"), "address", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("payload_bytes") >= least)
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    header = F.concat(
        F.lit(VERSION + EOL),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(EPOCH)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("keeper"))))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(EOL),
    )
    small.select("page_id", header.cast("binary").alias("header"), "address").write.mode("overwrite").parquet(f"{path}/headers")


def headers(spark, path: str) -> DataFrame:
    """(page_id, header, address): the exact header bytes of each record."""
    return spark.read.parquet(f"{path}/headers")


def payloads(spark, path: str) -> DataFrame:
    """(address, payload): each distinct payload once. Bytes whose SHA-256 is not their address make the read fail."""
    right = F.unhex(F.sha2("payload", 256)) == F.col("address")
    checked = F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("address"))).cast("binary"))
    return spark.read.parquet(f"{path}/payloads").select("address", checked.alias("payload"))


def records(spark, path: str) -> DataFrame:
    """(page_id, record, payload): the original records, header and block as they stand in a WARC file, and the full payload each stands for; a revisit has no block."""
    both = headers(spark, path).join(payloads(spark, path), "address")
    block = F.when(F.contains("header", F.lit(b"\r\nWARC-Type: revisit\r\n")), F.lit(b"")).otherwise(F.col("payload"))
    return both.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def summary(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, read from the rebuilt record.

    The digest is that of the payload's bytes; a record whose header names another, or whose block is not as long as it says, makes the read fail.
    """
    end = F.position(F.lit(b"\r\n\r\n"), F.col("record"))
    rows = records(spark, path).select("page_id", "record", "payload", end.alias("end"))
    rows = rows.select("page_id", "payload", F.substring("record", F.lit(1), F.col("end") + 1).cast("string").alias("head"), (F.octet_length("record") - F.col("end") - 7).alias("block_bytes"))
    field = lambda name, what: F.regexp_extract("head", f"\n{name}: {what}\r\n", 1)
    digest = base32_sha1(F.col("payload"))
    right = (field("WARC-Payload-Digest", r"sha1:(\w+)") == digest) & (field("Content-Length", r"(\d+)").cast("long") == F.col("block_bytes"))
    kind = headers(spark, path).schema["page_id"].dataType
    to = field("WARC-Refers-To", r"<urn:page:([^>]*)>")
    return rows.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(right, digest).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("head")))).alias("payload_digest"),
        field("WARC-Type", r"(\w+)").alias("record_type"),
        F.when(to != "", to).cast(kind).alias("refers_to"),
    )


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` to an archive in the cluster's shared folder and read it back: see write_archive and summary. Every row returns."""
    path = shared_dir(pages.sparkSession)
    write_archive(pages, path, least)
    return summary(pages.sparkSession, path)
