"""WARC archives as tables of record chunks, written and read with Spark's own text source.

Every payload becomes rows of record identifier and chunk number, with a digest that runs along; only
these rows are written, joined and read. An archive line ends where the next record's version line
begins. Chunks of a payload are WARC segments: a first record and continuation records. A payload is
also cut inside every ``WARC/1.1`` that it holds, so that this string starts records only
and the archives can be read back, split and in parallel, with it as the line separator.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut_lineage, remove, shared_folder

_VERSION = "WARC/1.1"
_CRLF = "\r\n"
#: The digits of conv() to base 32, and the base32 alphabet.
_DIGITS, _ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from four 40-bit groups of its hexadecimal form.

    The SHA-1 stands in it once for each group. A projection computes it once, a branch of a CASE each
    time: make it a column before it is compared.
    """
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in range(1, 41, 10)]
    return F.translate(F.concat(*groups), _DIGITS, _ALPHABET)


_VERSION_BYTES = re.compile(re.escape(_VERSION).encode())
_CHUNK_ROW = "chunk_no int, last boolean, payload_bytes long, payload_digest string, data binary"


def pieces(payload: memoryview, chunk: int) -> Iterator[tuple[int, int]]:
    """Borders of the chunks of a payload: at most ``chunk`` bytes each, none with a version string; an empty payload has one."""
    start = 0
    for found in (*_VERSION_BYTES.finditer(payload), None):
        end = len(payload) if found is None else found.start() + 2
        while start < end or (found is None and start == 0):
            stop = min(end, start + chunk)
            yield start, stop
            start = stop
            if stop == len(payload):
                return


def chunk_table(pages: DataFrame, path: str, chunk: int = 1 << 14, flush: int = 1 << 22) -> DataFrame:
    """``pages`` (page_id, url, html) as a chunk table, written to ``path``: nr, page_id, url, chunk_no, last, payload_bytes, payload_digest, data.

    ``nr`` tells rows apart. Payloads are cut where they are read, as views of the bytes in the batch;
    chunks leave the task in batches of about ``flush`` bytes. A digest runs along with the chunks of a
    payload, and the last one carries it (null in the others).
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.monotonically_increasing_id().alias("nr"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    schema = f"nr long, page_id long, url string, {_CHUNK_ROW}"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for nr, page_id, url, payload in zip(batch["nr"].to_pylist(), batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["payload"]):
                whole, digest = memoryview(payload.as_buffer()), hashlib.sha1()
                for i, (start, stop) in enumerate(pieces(whole, chunk)):
                    digest.update(whole[start:stop])
                    last = stop == len(whole)
                    out.append((nr, page_id, url, i, last, len(whole), b32encode(digest.digest()).decode() if last else None, bytes(whole[start:stop])))
                    held += stop - start + 200
                    if held >= flush:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    rows.mapInArrow(cut, schema).write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(schema).parquet(path)


def revisits(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows nr, first_id, first_nr, digest of a chunk table that revisit another: of equal payloads of ``least_bytes`` or more all but that with the largest page_id (of those that repeat it, one).

    Ids and digests are grouped and joined, no payload is.
    """
    meta = chunks.where(F.col("last") & (F.col("payload_bytes") >= least_bytes)).select("nr", "page_id", "payload_bytes", F.col("payload_digest").alias("digest"))
    first = meta.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "nr")).alias("first"), F.count("*").alias("copies"))  # a null id is less than any other
    first = first.where("copies > 1").select("digest", "payload_bytes", F.col("first.page_id").alias("first_id"), F.col("first.nr").alias("first_nr"))
    return meta.drop("page_id").join(first, ["digest", "payload_bytes"]).where("nr <> first_nr").drop("payload_bytes")


def write_archives(chunks: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a chunk table as gzipped archives under ``path``: a record, or several segments of one, for each payload, or one that revisits an equal payload.

    Responses hold an HTTP header and the payload, revisits the header alone and the identifier of the
    record they refer to. The header gives the length, the last segment the digest, of the full payload.
    """
    rows = chunks.join(revisits(chunks, least_bytes), "nr", "left")
    revisit = F.col("first_nr").isNotNull()
    rows = rows.where(~revisit | (F.col("chunk_no") == 0)).sortWithinPartitions("nr", "chunk_no")
    data = F.when(revisit, F.lit(b"")).otherwise(F.col("data"))
    later = F.col("chunk_no") > 0
    last = revisit | F.col("last")
    several = ~revisit & ~(F.col("last") & (F.col("chunk_no") == 0))

    def name(page_id: Column, nr: Column) -> Column:
        return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit("#"), nr.cast("string"))

    whole = name(F.col("page_id"), F.col("nr"))
    http = F.when(~later, F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))).otherwise("")
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20")
    url = F.replace(url, F.lit(_VERSION), F.lit("%57" + _VERSION[1:]))

    def line(name: str, value: Column | str, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(_CRLF))
        return text if when is None else F.when(when, text).otherwise("")

    header = F.concat(
        F.lit(_VERSION + _CRLF),
        line("WARC-Type", F.when(later, "continuation").when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), whole, F.when(later, F.concat(F.lit("/"), F.col("chunk_no").cast("string"))).otherwise(""), F.lit(">"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.coalesce("digest", "payload_digest")), last),
        line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", revisit),
        line("WARC-Refers-To", F.concat(F.lit("<"), name(F.col("first_id"), F.col("first_nr")), F.lit(">")), revisit),
        line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"), several),
        line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), whole, F.lit(">")), later),
        line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"), several & last),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", (F.octet_length(http) + F.octet_length(data)).cast("string")),
        F.lit(_CRLF),
    )
    record = F.concat(header.cast("binary"), http.cast("binary"), data, F.lit(_CRLF).cast("binary"))
    rows.select(record.cast("string").alias("value")).write.option("lineSep", _CRLF).option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records as a chunk table: record_id, chunk_no, record_type, page_id, url, refers_to, payload_digest, payload_bytes, last, data.

    ``payload_digest`` and ``payload_bytes`` are what the headers claim (the digest null in all but the
    last segment, the length in all but the first), ``data`` the chunk's own bytes. A record shorter than its Content-Length stops the job.
    """
    lines = spark.read.option("lineSep", _VERSION + _CRLF).text(path).where(F.octet_length("value") > 0)
    lines = lines.withColumn("head", F.substring_index("value", _CRLF * 2, 1)).withColumn("raw", F.col("value").cast("binary"))

    def field(name: str, of: str = "head") -> Column:
        found = F.regexp_extract(of, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    lines = lines.withColumn("block_at", F.octet_length("head") + 5).withColumn("block_bytes", field("Content-Length").cast("int"))
    whole = F.octet_length("raw") >= F.col("block_at") - 1 + F.col("block_bytes")
    block = F.when(whole, F.expr("substring(raw, block_at, block_bytes)")).otherwise(F.raise_error(F.lit("a WARC record is shorter than its Content-Length")).cast("binary"))
    lines = lines.withColumn("block", block).withColumn("type", field("WARC-Type")).withColumn("later", F.col("type") == "continuation")
    http = F.when(~F.col("later"), F.concat(F.substring_index(F.col("block").cast("string"), _CRLF * 2, 1), F.lit(_CRLF * 2)))
    lines = lines.withColumn("http", http)
    first_id = F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID"))
    return lines.select(
        first_id.alias("record_id"),
        (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk_no"),
        F.col("type").alias("record_type"),
        F.regexp_extract(first_id, r"^<urn:page:(-?\d+)#", 1).try_cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(-?\d+)#", 1).try_cast("long").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("Content-Length", "http").cast("long").alias("payload_bytes"),
        (field("WARC-Segment-Number").isNull() | field("WARC-Segment-Total-Length").isNotNull()).alias("last"),
        F.expr("substring(block, coalesce(octet_length(http), 0) + 1)").alias("data"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response are computed from what was read, and a digest other than the one
    claimed stops the job. Records of one chunk are digested in place; only chunks of segmented records
    are shuffled, sorted by record and number, and run through an incremental digest, so no payload is
    ever put together in memory.
    """
    bounded_batches(spark)
    chunks = read_chunks(spark, path)
    single = (F.col("chunk_no") == 0) & F.col("last")
    is_revisit = F.col("record_type") == "revisit"
    wrong = F.raise_error(F.concat(F.lit("the payload of "), F.col("record_id"), F.lit(" is not what was digested"))).cast("string")
    digest = F.when(is_revisit, F.col("payload_digest")).when(F.col("made") == F.col("payload_digest"), F.col("made")).otherwise(wrong)
    size = F.when(is_revisit, F.col("payload_bytes")).otherwise(F.octet_length("data").cast("long"))
    alone = chunks.where(single).withColumn("made", base32_sha1(F.col("data"))).select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
    several = chunks.where(~single).select("record_id", "chunk_no", "page_id", "last", "payload_digest", "data").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, state, n, expected = None, None, 0, 0
        for batch in batches:
            for record_id, chunk_no, page_id, last, claimed, data in zip(*(batch.column(i) for i in range(6))):
                if record_id.as_py() != record:
                    record, state, n, expected = record_id.as_py(), hashlib.sha1(), 0, 0
                if chunk_no.as_py() != expected:
                    raise ValueError(f"chunk {expected} of {record} is missing")
                expected += 1
                state.update(data.as_buffer())
                n += len(data.as_buffer())
                if last.as_py():
                    text = b32encode(state.digest()).decode()
                    if text != claimed.as_py():
                        raise ValueError(f"the payload of {record} is not what was digested")
                    yield pa.RecordBatch.from_pylist([{"page_id": page_id.as_py(), "payload_bytes": n, "payload_digest": text}], schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))

    joined = several.mapInArrow(digested, "page_id long, payload_bytes long, payload_digest string")
    return alone.unionByName(joined.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")))


def round_trip(pages: DataFrame, least_bytes: int = 0, chunk: int = 1 << 14) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC archives in the shared folder and read them back.

    One row per page. Of rows with equal payloads exactly one is a response, that with the largest
    page_id (of several such rows any; null ids are less than others), the rest revisit it. A null html
    counts as empty, null and repeated ids are kept, a null url is empty, other columns are ignored, an
    empty table gives an empty result. The chunk table and the archives are gone when this returns.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    try:
        write_archives(chunk_table(pages, f"{path}/chunks", chunk), f"{path}/archives", least_bytes)
        remove(spark, f"{path}/chunks")
        return cut_lineage(read_records(spark, f"{path}/archives"))
    finally:
        remove(spark, path)
