"""A content-addressed web archive: payload bytes once by verified digest, exact record headers apart."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, shared_dir

#: Records of payloads of fewer bytes are never revisits; the store holds these payloads once too.
LEAST_BYTES = 100
DATE = "2026-01-01T00:00:00Z"
END = "\r\n\r\n"


def _header() -> F.Column:
    """The exact header of a record: WARC fields, and for both types the HTTP header of the response."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    kept = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"),
        # a URL can't hold line ends, so they are escaped
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "payload_digest"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + kept).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), http)


def _deflated(batches: Iterator):
    """payload_digest, stored_bytes and stored: each payload as zlib data, so that shuffles and the store hold fewer bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        for part in pieces(batch, column="payload"):
            sizes = pc.binary_length(part.column("payload")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("payload_digest"), sizes, pa.array([zlib.compress(x.as_py()) for x in part.column("payload")], pa.binary())], names=["payload_digest", "stored_bytes", "stored"])


def _inflated(stored: bytes | None, size: int | None) -> bytes | None:
    """A stored payload; null where there is none, where it is broken, or where it isn't of the stored size. Never more than one byte too many."""
    if stored is None or size is None:
        return None
    data = zlib.decompressobj()
    try:
        payload = data.decompress(stored, size + 1)
        # the checksum at the end is read with the last bytes
        return payload if len(payload) == size and (data.eof or not data.decompress(data.unconsumed_tail, 1) and data.eof) else None
    except zlib.error:
        return None


def _payloads(batches: Iterator):
    """The records with payload in place of stored_bytes and stored, the last columns, in slices of bounded payload size."""
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, sizes=batch.column("stored_bytes")):
            payload = [_inflated(x.as_py(), n.as_py()) for x, n in zip(part.column("stored"), part.column("stored_bytes"), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(payload, pa.binary())], names=[*part.schema.names[:-2], "payload"])


def write_archive(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Write the archive of pages(page_id, url, html, ...) below path: tables headers and payloads.

    headers has a row per row of pages: page_id, record_type, refers_to, payload_digest, payload_bytes, header (exact).
    payloads has each distinct payload once: payload_digest, stored_bytes (its length), stored (zlib data). Of the records with equal payloads of at
    least least bytes, that with the smallest page_id is the response (all of them, if rows repeat it), the others are
    revisits of it. Null html is an empty payload. A row without an id is a revisit if a row with an id has its payload.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # one shuffle of digests and ids, joined back; the payloads stay where they are read until they are stored once
    slim = rows.drop("payload")
    first = slim.groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    typed = slim.join(first, "payload_digest").withColumn("again", F.coalesce((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    typed = typed.withColumn("record_type", F.when(F.col("again"), "revisit").otherwise("response")).withColumn("refers_to", F.when(F.col("again"), F.col("first")))
    typed.select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", _header().alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # the payloads' partial aggregation drops the copies of a task before the shuffle
    small = rows.select("payload_digest", "payload").mapInArrow(_deflated, "payload_digest string, stored_bytes long, stored binary")
    small.groupBy("payload_digest").agg(F.first("stored_bytes").alias("stored_bytes"), F.first("stored").alias("stored")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, record_type, refers_to, payload_digest, payload_bytes, header, payload.

    A payload whose SHA-256 isn't its address, or that is missing or of another length, raises an error.
    """
    headers, store = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    joined = headers.join(store, "payload_digest", "left").select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "header", "stored_bytes", "stored")
    records = joined.mapInArrow(_payloads, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, header string, payload binary")
    ok = F.coalesce((F.sha2("payload", 256) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes")), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("payload doesn't match its address "), "payload_digest"))
    return records.withColumn("payload_bytes", F.when(ok, F.octet_length("payload").cast("long")).otherwise(broken.cast("long")))


def warc_records(archive: DataFrame) -> DataFrame:
    """page_id and the original record: header, the payload of a response, and the record's end."""
    content = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise("")
    return archive.select("page_id", F.concat("header", content).alias("record"))


def write_warc(archive: DataFrame, path: str, per_file: int = 10_000) -> None:
    """WARC files below path, written by the tasks: each record ends with two line ends, as the text writer puts them."""
    warc_records(archive).select("record").write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def _parsed(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at a place, by its own bytes, and where its block ends."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at byte {at}")
    fields = dict(x.split(": ", 1) for x in lines)
    to = end + 4 + int(fields["Content-Length"])
    if to > len(data):
        raise ValueError(f"record {fields['WARC-Record-ID']} is shorter than its Content-Length")
    http, payload = data[end + 4 : to].split(b"\r\n\r\n", 1)
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    return {"record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"], "refers_to": fields.get("WARC-Refers-To"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": size, "payload": payload}, to


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: record_id, record_type, refers_to, payload_digest, payload (bytes)."""

    def parsed(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                data, at, rows = content.as_buffer().to_pybytes(), 0, []
                while at < len(data):
                    row, at = _parsed(data, at)
                    rows.append(row)
                    at += 4
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, "record_id string, record_type string, refers_to string, payload_digest string, payload binary")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload_bytes of an archive's records, each read from the bytes of the
    original record: the header joined with its payload where it is a response.

    Only responses meet their payloads, of which each of LEAST_BYTES or more has one; a revisit meets the stored length alone.
    A record that doesn't end with its Content-Length, a response whose payload hasn't the digest and length it names, and
    a revisit with a payload, without a reference or of a payload that isn't stored raise an error.
    """
    headers, store = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    first = headers.where("record_type = 'response'").join(store, "payload_digest", "left").select("header", "stored_bytes", "stored")
    again = headers.where("record_type <> 'response'").join(store.drop("stored"), "payload_digest", "left").select("header", "stored_bytes", F.lit(None).cast("binary").alias("stored"))

    def page(name: str | None) -> int | None:
        number = None if name is None else name.removeprefix("<urn:page:").removesuffix(">")
        return None if number in (None, "null") else int(number)

    def read(batches: Iterator):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])
        for batch in batches:
            rows = []
            for header, size, stored in zip(*(batch.column(c) for c in ("header", "stored_bytes", "stored")), strict=True):
                data = header.as_py().encode() + (_inflated(stored.as_py(), size.as_py()) or b"")
                r, to = _parsed(data)
                held = r.pop("payload")
                whole = hashlib.sha256(held).hexdigest() == r["payload_digest"] and len(held) == r["payload_bytes"]
                if to != len(data) or size.as_py() != r["payload_bytes"] or not (whole if r["record_type"] == "response" else not held and r["refers_to"]):
                    raise ValueError(f"record {r['record_id']} doesn't match its header")
                rows.append(r | {"page_id": page(r.pop("record_id")), "refers_to": page(r["refers_to"])})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return first.unionAll(again).mapInArrow(read, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long")


def archived(pages: DataFrame) -> str:
    """Write an archive of pages into the shared folder; its path."""
    path = f"{shared_dir(pages.sparkSession)}/dossier-archive-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return path
