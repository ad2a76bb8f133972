"""Web archives (WARC 1.1) with Zstandard: a frame for each record, the dictionary in a leading skippable frame.

Archives are written as tables are: a task packs records into archives of a bounded size, one a row, and Spark's writer
makes a file of each row, so that a lost task leaves nothing behind and any file system that Spark knows will do. What that writer puts at a
row's end is an empty skippable frame, which readers pass over. The dictionary is trained on a bounded sample
(``SAMPLE`` pages, ``SAMPLE_CHARS`` characters of each), which bears on the files' size alone.

The reader takes nothing but the files: it loads the dictionary from the leading frame, decodes the frames one by one, and holds
each record against its headers: version, mandatory fields, lengths of block, body and frame, and the digest of the payload.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded, hot_join, record_batch, slices, table

#: Fixed values of the formats.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, range(0x184D2A50, 0x184D2A60), 0x184D2A5D
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame, of ASCII letters only.
EMPTY = struct.pack("<II", SKIPPABLE[0], 0).decode("ascii")

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Compressed bytes of an archive, about; a larger record has one of its own.
ARCHIVE_BYTES = 32_000_000
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 16_384, 65_536
#: The tables have no times.
DATE = "2000-01-01T00:00:00Z"
ID = "urn:page:"
RECORD = (
    "file string, at long, record_type string, record_id string, uri string, refers_to_id string, "
    "payload_bytes long, payload_digest string, payload binary, fault string"
)
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def revisited(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (page_id, url, html) with html in bytes, their number and digest, and first: the page that is archived in its place, or null.

    Of equal payloads of ``least`` bytes or more the smallest page_id is the first; rows that share it all are. A null html is empty, and a null
    page_id is greater than all others.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest"))
    found = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = Workspace(pages.sparkSession, "revisits").save(found, "digests")
    few, small = bounded(found)
    met = rows.join(few.drop("n"), "digest", "left") if small else hot_join(rows, found, ["digest"], "n", pages.count())
    itself = F.col("first").eqNullSafe(F.col("page_id"))
    return met.withColumn("first", F.when(~itself, F.col("first"))).select(*rows.columns, "first")


def dictionary(pages: DataFrame) -> bytes:
    """Trained on about ``SAMPLE`` pages drawn by a hash, twice as many at most; empty where these are too few to learn from."""
    share = F.pmod(F.xxhash64("page_id", "url"), F.lit(max(pages.count(), 1))) < SAMPLE
    drawn = pages.where(share).select(F.substring("html", 1, SAMPLE_CHARS).alias("html")).limit(2 * SAMPLE)
    samples = [r["html"].encode() for r in drawn.collect() if r["html"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _field(value: str) -> str:
    """As a header's value: no spaces or controls."""
    return "".join(c if 0x21 <= ord(c) != 0x7F else quote(c) for c in value)


def _id(page_id: int | None) -> str:
    return f"<{ID}{'' if page_id is None else page_id}>"


def _record(kind: str, record_id: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, **fields, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"".join((b"WARC/1.1\r\n", lines.encode(), b"\r\n", block, b"\r\n\r\n"))


def page_record(page_id: int | None, url: str | None, html: bytes, digest: str, first: int | None) -> bytes:
    """A page as a response, or as a revisit of the page ``first``: then only the headers of its answer are kept."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    fields = {"WARC-Target-URI": _field(url) if url else _id(page_id)[1:-1], "WARC-Payload-Digest": f"sha256:{digest}"}
    fields["Content-Type"] = "application/http; msgtype=response"
    if first is None:
        return _record("response", _id(page_id), fields, http + html)
    return _record("revisit", _id(page_id), {**fields, "WARC-Profile": PROFILE, "WARC-Refers-To": _id(first)}, http)


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archive ``pages`` (page_id, url, html) in a new folder.

    A null html is empty, a null url the record's own name; characters that a header can't hold are percent-encoded. Repeated rows are
    archived each. Other columns, whatever their names, are ignored. An empty table makes a folder without archives.
    """
    learned = pages.sparkSession.sparkContext.broadcast(dictionary(pages))

    def run(batches):
        known = learned.value
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(known) if known else None, write_checksum=True)
        lead = []
        if known:
            packed = zstandard.compress(known)
            lead.append(struct.pack("<II", DICTIONARY, len(packed)) + packed)
        lead.append(pack.compress(_record("warcinfo", f"<{ID}info>", {"Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
        held, size = list(lead), 0
        for b in slices(batches, 256):
            for row in b.to_pylist():
                held.append(pack.compress(page_record(row["page_id"], row["url"], row["html"], row["digest"], row["first"])))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield record_batch({"archive": [b"".join(held)]}, "archive binary")
                    held, size = list(lead), 0
        if size:
            yield record_batch({"archive": [b"".join(held)]}, "archive binary")

    rows = revisited(pages).select("page_id", "url", "html", "digest", "first")
    archives = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY).text(path)


def frames(data: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(place, content, fault) of each Zstandard frame of an archive; nothing behind a broken frame can be told apart."""
    at, known = 0, None
    while at < len(data):
        if len(data) - at < 8:
            yield at, None, "cut off"
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                yield at, None, "cut off"
                return
            if magic == DICTIONARY and at == 0:
                try:
                    held = bytes(data[8 : 8 + size])
                    if held[:4] == struct.pack("<I", FRAME):
                        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                    known = zstandard.ZstdCompressionDict(held)
                except zstandard.ZstdError:
                    yield at, None, "dictionary"
                    return
            at += 8 + size
            continue
        if magic != FRAME:
            yield at, None, "no frame"
            return
        # The first piece holds most records; pieces grow, so that little behind the frame is copied.
        reader, parts, end, step = zstandard.ZstdDecompressor(dict_data=known).decompressobj(), [], at, 4096
        try:
            told = zstandard.frame_content_size(data[at : at + 18])
            while not reader.eof and end < len(data):
                parts.append(reader.decompress(data[end : end + step]))
                end, step = min(end + step, len(data)), min(2 * step, 1 << 20)
        except zstandard.ZstdError:
            yield at, None, "frame"
            return
        if not reader.eof:
            yield at, None, "cut off"
            return
        content = b"".join(parts)
        yield at, content, "frame length" if told not in (-1, len(content)) else None
        at = end - len(reader.unused_data)


def _fields(head: bytes) -> dict[bytes, bytes]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _number(value: bytes | None) -> int:
    return int(value) if value and value.isdigit() else -1


def parse(content: bytes) -> dict:
    """A record's columns, with the first fault found, if any."""
    head, split, rest = content.partition(b"\r\n\r\n")
    fields, out = _fields(head), dict.fromkeys(NAMES)
    out |= {
        n: fields[k].decode("utf-8", "replace").strip("<>")
        for n, k in (("record_type", b"warc-type"), ("record_id", b"warc-record-id"), ("uri", b"warc-target-uri"), ("refers_to_id", b"warc-refers-to"))
        if k in fields
    }
    length = _number(fields.get(b"content-length"))
    if head.split(b"\r\n", 1)[0] not in VERSIONS or not split:
        return {**out, "fault": "version"}
    if missing := [k for k in MANDATORY if not fields.get(k)]:
        return {**out, "fault": f"no {missing[0].decode()}"}
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        return {**out, "fault": "content-length"}
    payload, told = rest[:length], fields.get(b"warc-payload-digest", b"")
    if out["record_type"] in ("response", "revisit") and fields.get(b"content-type", b"").startswith(b"application/http"):
        http, split, payload = payload.partition(b"\r\n\r\n")
        body = _number(_fields(http).get(b"content-length"))
        if not split or not http.startswith(b"HTTP/"):
            return {**out, "fault": "http header"}
        if out["record_type"] == "revisit":
            fault = None if out["refers_to_id"] and told.startswith(b"sha256:") and not payload and body >= 0 else "revisit"
            return {**out, "payload_bytes": body, "payload_digest": told[7:].decode("ascii", "replace"), "fault": fault}
        if body not in (-1, len(payload)):
            return {**out, "fault": "body length"}
    digest = hashlib.sha256(payload).hexdigest()
    fault = "payload digest" if told.startswith(b"sha256:") and told[7:].decode("ascii", "replace") != digest else None
    return {**out, "payload_bytes": len(payload), "payload_digest": digest, "payload": payload, "fault": fault}


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder: type, ids, address, payload with its length and digest, and fault.

    A record that breaks a rule is a row with its fault, and so is what can't be decoded; the rows before it are whole. For a revisit,
    payload is null, and length and digest are those of the payload that it stands for. ``payloads`` = False leaves payload null.
    An archive without records gives no rows.
    """

    def run(batches):
        held, size = [], 0
        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                for at, content, fault in frames(memoryview(data.as_buffer())):
                    row = parse(content) if content is not None else dict.fromkeys(NAMES)
                    row |= {"file": file.as_py(), "at": at, "fault": fault or row["fault"], "payload": row["payload"] if payloads else None}
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if len(held) == 1000 or size > 4_000_000:
                        yield record_batch({n: [r[n] for r in held] for n in NAMES}, RECORD)
                        held, size = [], 0
        yield record_batch({n: [r[n] for r in held] for n in NAMES}, RECORD)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with a fault for each revisit whose response is not there with the same length and digest."""
    held = records.where("record_type = 'response' AND fault IS NULL").select("record_id", "payload_bytes", "payload_digest").distinct()
    held = held.select(F.col("record_id").alias("refers_to_id"), "payload_bytes", "payload_digest", F.lit(True).alias("there"))
    met = records.join(held, ["refers_to_id", "payload_bytes", "payload_digest"], "left")
    lost = (F.col("record_type") == "revisit") & F.col("there").isNull()
    return met.withColumn("fault", F.coalesce("fault", F.when(lost, "refers to nothing"))).select(*records.columns)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'warc').path}/archives"
    write(table(spark, sf_dir, "pages"), path)
    found = resolved(read(spark, path, payloads=False)).where("record_type <> 'warcinfo' OR record_type IS NULL")
    page = lambda c: F.expr(f"cast(nullif(substr({c}, {len(ID) + 1}), '') AS long)")
    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"), "fault"
    )


SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS fault
FROM p LEFT JOIN g USING (payload_digest)
"""
