"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Archives are written by Spark's text writer, so they reach any file system and half-written ones never show. Its row separator is an empty
skippable frame, which every Zstandard reader passes over. Each task writes one archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed values of the formats: frame magic numbers, the dictionary's skippable magic, an empty skippable frame, the revisit profile.
FRAME = 0xFD2FB528
DICTIONARY = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class BadArchive(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(uri: str) -> int | None:
    text = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers and drops the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page)}", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url and url.strip() else []), f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {REVISIT}"] if revisit else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(block: bytes, what: str) -> tuple[dict[str, str], bytes]:
    head, gap, rest = block.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive(f"{what}: headers do not end")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith(what):
        raise BadArchive(f"{what} expected, found {first[:20]!r}")
    pairs = [x.partition(":") for x in lines]
    if any(not sep for _, sep, _ in pairs):
        raise BadArchive(f"{what}: a header without colon")
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest


def parse(data: bytes) -> tuple:
    """Checks one record's headers, lengths and digest."""
    head, rest = _fields(data, "WARC/")
    try:
        kind, size = head["warc-type"], int(head["content-length"])
        page, claimed = _page(head["warc-record-id"]), head["warc-payload-digest"].removeprefix("sha1:")
        revisit = kind == "revisit"
        refers = _page(head["warc-refers-to"]) if revisit else None
    except (KeyError, ValueError) as e:
        raise BadArchive(f"bad or missing header: {e}") from e
    if kind not in ("response", "revisit") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"record type {kind!r} or length {size} is wrong")
    http, payload = _fields(rest[:size], "HTTP/")
    length = int(http.get("content-length", -1))
    if not revisit and (length != len(payload) or digest(payload) != claimed):
        raise BadArchive("payload does not match its length and digest")
    return page, head.get("warc-target-uri"), length, claimed, kind, refers, None if revisit else payload


def frames(archive: bytes):
    """Payload of each record frame; the dictionary comes from the leading skippable frame."""
    if len(archive) < 8:
        raise BadArchive("archive is too short")
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY or 8 + size > len(archive):
        raise BadArchive("no leading dictionary frame")
    known = zstandard.ZstdCompressionDict(archive[8 : 8 + size]) if size else None
    reader, at, view = zstandard.ZstdDecompressor(dict_data=known), 8 + size, memoryview(archive)
    while at < len(archive):
        if at + 4 > len(archive):
            raise BadArchive("trailing bytes")
        (magic,) = struct.unpack_from("<I", archive, at)
        if magic in SKIPPABLE:
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            if at > len(archive):
                raise BadArchive("a skippable frame is cut off")
            continue
        if magic != FRAME:
            raise BadArchive(f"unknown frame {magic:#x}")
        one = reader.decompressobj()
        try:
            data = one.decompress(view[at:])
        except zstandard.ZstdError as e:
            raise BadArchive(str(e)) from e
        if not one.eof:
            raise BadArchive("the last frame is cut off")
        at = len(archive) - len(one.unused_data)
        yield data


def train(pages: DataFrame, html_col: str, samples: int, size: int) -> bytes:
    """A dictionary from at most ``samples`` pages, those of the smallest text hashes; empty if they are too few to train on."""
    texts = pages.filter(F.length(html_col) > 0).select(F.xxhash64(html_col).alias("h"), F.substring(F.encode(html_col, "UTF-8"), 1, 1 << 14).alias("x"))
    smallest = texts.select("h").distinct().orderBy("h").limit(samples).agg(F.max("h")).first()[0]
    rows = texts.filter(F.col("h") <= smallest).groupBy("h").agg(F.min("x").alias("x")).orderBy("h").collect() if smallest is not None else []
    try:
        return zstandard.train_dictionary(size, [record(0, "http://", bytes(r.x), None, False) for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, level: int = 3, samples: int = 256, dictionary_bytes: int = 1 << 15) -> None:
    """Writes archives of ``pages`` to ``path``.

    Among equal payloads of at least ``min_bytes`` bytes, the record of the smallest id is a response and the others revisit it; shorter ones are
    all responses. Null html is an empty payload; a null id is larger than any other (a group of only null ids is all responses); rows that repeat the smallest id are all
    responses. The dictionary is trained on a bounded sample (``samples`` pages). An archive is one input partition: size it by
    ``spark.sql.files.maxPartitionBytes`` (an archive is read back as a whole, so under 2 GB).

    Equal payloads are counted by digest with partial aggregation; only digests held twice join back, a left join whose hot keys AQE splits.
    """
    known = train(pages, html_col, samples, dictionary_bytes)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    long_enough = F.length("body") >= min_bytes
    first = rows.filter(long_enough).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    rows = rows.join(first, "sha", "left").select("id", "url", "body", F.when(long_enough & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def archive(batches):
        tool = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(known) if known else None, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY, len(known)) + known
        for batch in batches:
            out = [] if lead is None else [lead]
            lead = None
            for page, url, body, refers in zip(*(batch.column(k).to_pylist() for k in ("id", "url", "body", "refers_to"))):
                out.append(tool.compress(record(page, url, body, refers, refers is not None)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    rows.mapInArrow(archive, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode()).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``; a bad frame, header, length or digest fails the job with ``BadArchive``."""

    def records(batches):
        for batch in batches:
            for content in batch.column("content"):
                part, size = [], 0
                for data in frames(content.as_py()):
                    part.append(parse(data))
                    size += len(data)
                    if size > 1 << 22:
                        yield table(part)
                        part, size = [], 0
                if part:
                    yield table(part)

    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def table(part):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter(F.col("length") > 0).select("content")
    return files.mapInArrow(records, READ_SCHEMA)
