"""WARC archives with records compressed one by one under a Zstandard dictionary of their own."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, skew_join

#: Magic number of the leading skippable frame that holds the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 16 << 20, 32 << 10, 1 << 20, 3
#: Records without payload that every dictionary is trained on besides the archive's own.
BARE = 64
#: A skippable frame without content, which ends each file; its bytes are all ASCII.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
#: Fixed date of the records, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, url: str | None, sha: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, repr((page_id, url, sha, nth)))}>"


def build_record(page_id, url: str | None, ident: str, size: int, digest: str, payload: bytes | None = None, refers_to=None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload and refers to (page, identifier) of the record it repeats."""
    block = b"" if payload is None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    target = "".join(c for c in url or "" if c > " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {ident}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target}"] * bool(target)
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if payload is None:
        page, record = refers_to
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record}", f"X-Refers-To-Page: {'' if page is None else page}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@lru_cache(maxsize=1)
def bare_records() -> list[bytes]:
    """Records without payload, of BARE invented pages."""
    return [build_record(i, f"http://example.org/{i}", record_id(i, None, "", 0), 0, payload_digest(b"%d" % i), b"") for i in range(BARE)]


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on records spread evenly over the archive, SAMPLE_BYTES in all, and always on the bare
    records too, which are enough to train on however few and small the archive's own are."""
    share = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    return zstandard.train_dictionary(DICTIONARY_BYTES, [*bare_records(), *records[::share]], k=256, d=8, level=LEVEL)


def build_archive(records: list[bytes]) -> bytes:
    """A skippable frame with the dictionary (itself a Zstandard frame), then a frame for each record."""
    dictionary = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    dictionary.precompute_compress(level=LEVEL)
    write = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(packed)), packed, *map(write.compress, records)])


def read_archive(data: bytes):
    """(headers, payload) of each record, by the archive's own bytes alone."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    dictionary = zstandard.ZstdCompressionDict(raw)
    read = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = memoryview(data)[8 + size :]
    while len(rest):
        magic, size = struct.unpack_from("<II", rest)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            rest = rest[8 + size :]
            continue
        one = read.decompressobj()
        record = one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]
        head, _, block = record.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
        block = block[: int(headers["Content-Length"])]
        yield headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the pages to `folder`, on any file system Spark can write: a file for each archive.

    The page with the smallest id of each set of equal payloads of at least `least` bytes becomes a
    response, the others revisits of it; smaller payloads are all responses. A null id comes after all
    others. Rows equal in id, address and payload are records of their own, told apart by a number in
    their identifiers. A payload crosses the network once however many rows bear it: revisits come
    from digests. Each task fills archives of about archive_bytes one after the other, so what it
    holds does not grow with the table.

    Spark's text writer puts the bytes down as they are and ends each file with an empty skippable
    frame; a job that fails leaves no file behind."""
    tables = Tables(pages.sparkSession, "warc")
    body = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body")).withColumn("sha", F.sha2("body", 256))
    size = F.octet_length("body").cast("long")
    who = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    keys = rows.where(size >= least).groupBy("page_id", "url", "sha", F.sha1("body").alias("sha1"), size.alias("n")).agg(F.count(F.lit(1)).alias("copies"))
    keys = tables.save(keys, "keys")
    heads = keys.groupBy("sha").agg(F.min(who).alias("head"), F.sum("copies").alias("all")).where(F.col("all") > 1).select("sha", "head")
    again = skew_join(keys, tables.save(heads, "heads"), "sha")
    more = F.col("copies") - F.when(who.eqNullSafe(F.col("head")), 1).otherwise(0)
    revisits = again.where(more > 0).select("page_id", "url", "sha", "sha1", "n", F.lit(None).cast("binary").alias("body"), F.col("head.page_id").alias("to_page"), F.col("head.url").alias("to_url"), F.explode(F.sequence(F.lit(1), more.cast("int"))).alias("nth"))
    single = [F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("long").alias("n"), "body", F.lit(None).cast("long").alias("to_page"), F.lit(None).cast("string").alias("to_url")]
    firsts = rows.where(size >= least).groupBy("sha").agg(F.first("body").alias("body"), F.min(who).alias("head"))
    firsts = firsts.select("head.page_id", "head.url", "sha", *single, F.lit(0).alias("nth"))
    small = rows.where(size < least).groupBy("page_id", "url", "sha", "body").agg(F.count(F.lit(1)).alias("copies"))
    small = small.select("page_id", "url", "sha", *single, F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("nth"))
    # small ones have no part in the table of firsts, so ids of both can't be equal

    def write(batches):
        records, held = [], 0
        for batch in batches:
            for page, link, sha, sha1, n, payload, to_page, to_url, nth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if payload is None:
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    records.append(build_record(page, link, record_id(page, link, sha, nth), n, digest, refers_to=(to_page, record_id(to_page, to_url, sha, 0))))
                else:
                    records.append(build_record(page, link, record_id(page, link, sha, nth), len(payload), payload_digest(payload), payload))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([build_archive(records)], pa.binary())], ["content"])
                    records, held = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([build_archive(records)], pa.binary())], ["content"])

    every = firsts.unionByName(revisits) if not least else firsts.unionByName(revisits).unionByName(small)
    archives = every.mapInArrow(write, "content binary").select(F.col("content").cast("string").alias("value"))
    tables.write(archives.write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME.decode()), "text", folder)
    tables.drop_all()


def read_archives(spark, folder: str) -> DataFrame:
    """(path, content) of the archives in a folder."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def read_pages(archives: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of the payload read back, checked against its header;
    a revisit's come from its header."""

    def read(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                out = []
                for head, payload in read_archive(content):
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    size = int(head["X-Payload-Length"])
                    if kind == "response":
                        if payload_digest(payload) != digest:
                            raise ValueError("payload digest differs")
                        size = len(payload)
                    page, to = head.get("X-Page-ID", ""), head.get("X-Refers-To-Page", "")
                    out.append((int(page) if page else None, head.get("WARC-Target-URI"), size, digest, kind, int(to) if to else None))
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return archives.select("content").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def page_records(pages: DataFrame, **options) -> DataFrame:
    """Archive the pages and read the archives back: a row for each page.

    A null html is an empty payload, a null page_id stays null and comes after all others; of rows of
    the same page_id and payload one is the response if that id is the smallest of the payload.
    Payloads of any length are records of their own; one longer than an archive fills it alone. An
    empty table gives no rows. Other columns are ignored, whatever their names."""
    tables = Tables(pages.sparkSession, "archives")
    folder = f"{tables.folder}/warc"
    write_archives(pages, folder, **options)
    return read_pages(read_archives(pages.sparkSession, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
