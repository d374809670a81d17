"""A content-addressed archive of WARC records.

Writing: every page is one record. Of pages with equal payloads one record, the
``response``, holds the payload; the others are ``revisit`` records that refer to it. The
files are gzip-compressed WARC/1.1, written by Spark's own writer, so they go to any
store that Spark reaches.

Reading: the files are parsed by their Content-Length. ``headers`` has the exact header
bytes of each record with the strong digest (SHA-256) of its payload; ``payloads`` has
each payload once, under a digest that is recomputed and compared with both declared
ones. ``reconstruct`` joins them to the original records, byte for byte.

Defined cases: a null html is the empty payload; a null page_id or url is left out of the
headers and read back as null; of repeated rows one is the response and the others are
revisits; pages with one payload and equal page_ids are told apart by url, then number;
an empty table gives an empty archive; a page of any length is one record, in memory as a whole; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import checkpointed, columns, shared_folder, ship_package

RECORDS_A_FILE = 2000
#: Part of every record: when the corpus was written is not in the table.
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a SHA-1 in hex: each five hex digits are four characters."""
    signs = []
    for at in range(0, 40, 5):
        number = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        signs += [F.substring(F.lit(_BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*signs)


def _line(name: str, value: Column) -> Column:
    """A header line; left out if the value is null. Line breaks in a value are percent-escaped."""
    safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def placed(pages: DataFrame) -> DataFrame:
    """Every page with its payload, the digest and who holds the payload: ``to_id``, ``to_url``, ``holds``."""
    rows = columns(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("sha256", F.sha2("payload", 256)).withColumn("copy", F.lit(1))
    # who holds a payload is decided on narrow rows, combined before the shuffle
    known = checkpointed(rows.groupBy("sha256", "page_id", "url").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct("page_id", "url")
    holders = known.groupBy("sha256").agg(F.max(order).alias("holder"))
    holders = holders.select("sha256", F.col("holder.page_id").alias("to_id"), F.col("holder.url").alias("to_url"))
    twice = known.where("n > 1").select(
        F.col("sha256").alias("_s"), F.col("page_id").alias("_p"), F.col("url").alias("_u"), "n"
    )
    if twice.take(1):  # repeated rows are numbered: one of each is kept and written n times
        same = (F.col("sha256") == F.col("_s")) & F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u"))
        numbers = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")
        repeated = rows.join(twice, same).groupBy("sha256", "page_id", "url").agg(
            F.first("payload").alias("payload"), F.first("n").alias("n")
        ).select("page_id", "url", "payload", "sha256", numbers)
        rows = rows.join(twice, same, "left_anti").unionByName(repeated)
    holds = F.col("page_id").eqNullSafe(F.col("to_id")) & F.col("url").eqNullSafe(F.col("to_url")) & (F.col("copy") == 1)
    return rows.join(holders, "sha256").withColumn("holds", holds)


def _record_id() -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("page_id", "copy", "url")]
    digest = F.md5(F.concat_ws(" ", *parts))
    cuts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(response: Column) -> Column:
    """The whole WARC record of a row of ``placed``, without the line breaks that end it."""
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit(_END), F.when(response, F.col("payload")).otherwise(F.lit("")),
    )
    kind = F.when(response, F.lit("response")).otherwise(F.lit("revisit"))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind),
        _line("WARC-Record-ID", _record_id()),
        F.lit(f"WARC-Date: {DATE}\r\n"), _line("WARC-Target-URI", F.col("url")), _line("X-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.sha1("payload")))),
        _line("X-Payload-SHA-256", F.col("sha256")), _line("X-Payload-Length", F.octet_length("payload")),
        _line("WARC-Profile", F.when(~response, profile)), _line("X-Refers-To-Page-ID", F.when(~response, F.col("to_id"))),
        _line("WARC-Refers-To-Target-URI", F.when(~response, F.col("to_url"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    return F.concat(head, _line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block)


def write_archive(pages: DataFrame, folder: str) -> str:
    """Write one record per page as gzip-compressed WARC files; returns the folder."""
    rows = placed(pages).select(_record(F.col("holds")).alias("value"))
    writer = rows.write.option("lineSep", _END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_A_FILE).text(folder)  # a record ends with two line breaks
    return folder


def parse(data: bytes):
    """(header bytes, fields, payload) of every record of an uncompressed WARC file; the header bytes are
    those of the record and, for HTTP, of the message in it."""
    at, size = 0, len(data)
    while at < size:
        end = data.index(b"\r\n\r\n", at) + 4
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            if name:
                fields[name] = value
        stop = end + int(fields["Content-Length"])
        inner = end
        if fields.get("Content-Type", "").startswith("application/http"):
            found = data.find(b"\r\n\r\n", end, stop)
            inner = stop if found < 0 else found + 4
        yield data[at:inner], fields, data[inner:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} does not end at its Content-Length")
        at = stop + 4


def unzipped(data: bytes) -> bytes:
    """All gzip members of a file; each record may be one of its own."""
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data
    return b"".join(parts)


_READ = (
    "record_id string, page_id long, url string, record_type string, refers_to long, sha256 string, sha1 string, "
    "length long, header binary, payload binary"
)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archive's files, its digests verified where it holds a payload.

    Archives of other writers are read as well: digests that they do not declare are computed, and records
    other than revisits hold their payload. One file is in memory at a time; this writer's files have at most
    ``RECORDS_A_FILE`` records.
    """
    import base64

    ship_package(spark)
    names = [part.split(" ")[0] for part in _READ.split(", ")]

    def row(header, fields, payload):
        holds, name = fields["WARC-Type"] != "revisit", fields.get("WARC-Record-ID")
        kind, _, sha1 = fields.get("WARC-Payload-Digest", "").partition(":")
        sha1 = sha1 if kind.lower() == "sha1" else None
        sha256, length = fields.get("X-Payload-SHA-256"), fields.get("X-Payload-Length")
        if holds:
            found = hashlib.sha256(payload).hexdigest(), base64.b32encode(hashlib.sha1(payload).digest()).decode(), str(len(payload))
            if any(said not in (None, own) for said, own in zip((sha256, sha1, length), found)):
                raise ValueError(f"payload of {name} does not have its digest")
            sha256, sha1, length = found
        number = lambda value: None if value is None else int(value)
        return (
            name, number(fields.get("X-Page-ID")), fields.get("WARC-Target-URI"), fields["WARC-Type"],
            number(fields.get("X-Refers-To-Page-ID")), sha256, sha1, number(length), header, payload if holds else None,
        )

    def run(batches):
        types = pa.schema([
            (n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string()))
            for n, t in (part.split(" ") for part in _READ.split(", "))
        ])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in parse(unzipped(content.as_py())):
                    rows.append(row(*record))
                    if len(rows) == 256:
                        yield _batch(rows, names, types)
                        rows = []
                if rows:
                    yield _batch(rows, names, types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(run, _READ)


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)


def headers(archive: DataFrame) -> DataFrame:
    """The records without their payloads: exact header bytes and the digest to find the payload by."""
    return archive.drop("payload")


def payloads(archive: DataFrame) -> DataFrame:
    """``(sha256, payload)``: each payload once, whatever number of archives holds it; verified when it was read."""
    return archive.where("payload is not null").select("sha256", "payload").dropDuplicates(["sha256"])


def with_digests(records: DataFrame, archive: DataFrame) -> DataFrame:
    """``records`` whose SHA-256 is not declared (revisits of other writers) get it from the payload with their SHA-1."""
    known = archive.where("payload is not null").select("sha1", F.col("sha256").alias("_found")).dropDuplicates(["sha1"])
    return records.join(known, "sha1", "left").withColumn("sha256", F.coalesce("sha256", "_found")).select(*records.columns)


def reconstruct(records: DataFrame, store: DataFrame) -> DataFrame:
    """Records with ``payload`` (also of a revisit; null if no archive holds it) and ``record``, the original bytes."""
    joined = records.join(store, "sha256", "left")
    own = F.when(F.col("record_type") != "revisit", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat("header", own))


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages as an archive, read it back and return what each page's record says of its payload."""
    spark = pages.sparkSession
    folder = write_archive(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    archive = read_archive(spark, folder)
    return reconstruct(checkpointed(headers(archive)), payloads(archive)).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to",
    )
