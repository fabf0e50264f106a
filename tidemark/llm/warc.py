"""A content-addressed web archive.

Payload bytes are stored once per SHA-256 digest, compressed; the exact header of every record
is kept in a table of its own and names its payload by digest.  Reading joins the two again,
checks every payload against its address, rebuilds the bytes of every record and takes what it
tells from those bytes.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.words import in_small_batches
from tidemark.settings import settle, work_path

REVISIT_BYTES = 100
END = "\r\n"
RECORD_END = b"\r\n\r\n"
WHEN = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _one_line(text: Column) -> Column:
    """A header value: control characters percent-encoded, null empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _header(digest: Column, size: Column, kind: Column, refers_to: Column) -> Column:
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        size.cast("string"), F.lit(END + END),
    )
    block = F.octet_length(http) + F.when(kind == "response", size).otherwise(0)
    return F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), kind,
        F.lit(f"{END}WARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit(f"{END}WARC-Date: {WHEN}{END}WARC-Target-URI: "), _one_line(F.col("url")),
        F.lit(f"{END}WARC-Payload-Digest: sha256:"), digest,
        F.when(
            kind == "revisit",
            F.concat(F.lit(f"{END}WARC-Refers-To: "), _urn(refers_to), F.lit(f"{END}WARC-Profile: {PROFILE}")),
        ).otherwise(""),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "),
        block.cast("string"), F.lit(END + END), http,
    )


def write_archive(pages: DataFrame, folder: str) -> None:
    """Write ``pages`` (page_id, url, html) as ``folder/headers`` and ``folder/payloads``.

    Among records with equal payloads of at least 100 bytes the smallest page_id is the
    response and the others revisit it; smaller payloads are always responses.  A null html
    is an empty payload, a null url an empty one.  A record without page_id revisits the
    smallest id of its payload, and is a response when no record of the payload has an id.
    Rows that share the smallest id are all responses.  Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    held = pages.select(
        "page_id", "url", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")
    )
    shared = (
        held.where(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    linked = held.join(shared, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    linked.select(
        "page_id", "digest",
        _header(F.col("digest"), F.col("size"), kind, F.col("first")).alias("header"),
    ).write.parquet(f"{folder}/headers")
    (
        in_small_batches(pages).select(F.sha2(payload, 256).alias("digest"), _packed(payload).alias("payload"))
        .dropDuplicates(["digest"])
        .write.parquet(f"{folder}/payloads")
    )


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("page_id long, digest string, header string").parquet(f"{folder}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header"), rf"\n{name}: ([^\r]*)\r\n", 1)


def _packed(payload: Column) -> Column:
    def pack(payload: pd.Series) -> pd.Series:
        close = zstandard.ZstdCompressor()
        return payload.map(close.compress)

    return F.pandas_udf(pack, "binary")(payload)


def _rebuilt(header: Column, digest: Column, packed: Column) -> Column:
    """A response's bytes; a payload that is missing or does not fit its address stops the job."""

    def rebuild(header: pd.Series, digest: pd.Series, packed: pd.Series) -> pd.Series:
        open_ = zstandard.ZstdDecompressor()
        out = []
        for head, address, stored in zip(header, digest, packed):
            if stored is None:
                raise ValueError(f"payload {address} is missing")
            payload = open_.decompress(stored)
            if hashlib.sha256(payload).hexdigest() != address:
                raise ValueError(f"payload does not match its address {address}")
            out.append(head.encode() + payload + RECORD_END)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(rebuild, "binary")(header, digest, packed)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's bytes as they stand in a WARC file: ``page_id, record``.

    Only responses carry a payload, so a payload joins once however many records revisit it.
    """
    stored = in_small_batches(spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads"))
    headers = _headers(spark, folder)
    response = _field("WARC-Type") == "response"
    whole = headers.where(response).join(stored, "digest", "left").select(
        "page_id", _rebuilt(F.col("header"), F.col("digest"), F.col("payload")).alias("record")
    )
    bare = headers.where(~response).select(
        "page_id", F.concat(F.col("header").cast("binary"), F.lit(RECORD_END)).alias("record")
    )
    return whole.unionByName(bare)


def parse_record(record: bytes) -> tuple:
    """``page_id, url, record_type, digest, refers_to, payload_bytes`` of one record's bytes.

    The size is the payload's in the record, so null for a revisit.  A record whose lengths or
    digest contradict its bytes raises.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(END)[1:])
    block, tail = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]):]
    if tail != RECORD_END:
        raise ValueError(f"record {fields['WARC-Record-ID']} does not end where its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(re.search(rb"Content-Length: (\d+)$", http)[1]) if kind == "response" else None
    if size is not None and (size != len(payload) or digest != hashlib.sha256(payload).hexdigest()):
        raise ValueError(f"record {fields['WARC-Record-ID']} contradicts its payload")
    ids = [re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, "")) for name in ("WARC-Record-ID", "WARC-Refers-To")]
    page, refers = (int(found[1]) if found else None for found in ids)
    return page, fields["WARC-Target-URI"], kind, digest, refers, size


PARSED = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long"


def _told(record: Column) -> Column:
    def told(record: pd.Series) -> pd.DataFrame:
        names = [part.split()[0] for part in PARSED.split(", ")]
        return pd.DataFrame([parse_record(bytes(r)) for r in record], columns=names, dtype=object)

    return F.pandas_udf(told, PARSED)(record)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    Every record is rebuilt and parsed.  Digest and size of a response are those of the payload in
    its bytes; a revisit takes the size from the record it refers to, which must hold the payload.
    """
    parsed = settle(records(spark, folder).select(_told(F.col("record")).alias("r")).select("r.*"), "records")
    revisit = F.col("record_type") == "revisit"
    held = (
        parsed.where(~revisit & (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("payload_bytes").alias("payload_bytes"))
    )
    missing = F.raise_error(F.concat(F.lit("no response holds the payload "), F.col("payload_digest"))).cast("long")
    again = (
        parsed.where(revisit).drop("payload_bytes").join(held, ["refers_to", "payload_digest"], "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", missing))
    )
    return parsed.where(~revisit).unionByName(again).select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def archive_of(pages: DataFrame) -> str:
    """Write a new archive into the shared folder and return its place."""
    folder = work_path(pages.sparkSession, "warc")
    write_archive(pages, folder)
    return folder
