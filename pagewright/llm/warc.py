"""WARC archives: segmented writing, reading, reassembly and chunked transfer decoding.

A record longer than a segment is written as a first segment and ``continuation``
records, which may stand in any file and order. The reader parses each archive file
alone, and only the segments of split records are shuffled, by origin identifier: a
group is ordered by segment number and joined only if it is gapless and has the
total length that its last segment states. Payloads framed by ``Transfer-Encoding:
chunked`` are unframed after the reassembly. What a revisit says of its payload is checked against the response it names.

Archives go through Spark's own file writer and reader, so any file system that
Spark knows can hold them, and a lost task leaves no half-written file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import release, remove, scratch, skew_join, small_side, stored, text_batches

_HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"  # the tables hold no fetch time; a constant keeps retried tasks identical


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(row: str, suffix: str = "") -> str:
    """An identifier of a record; ``row`` tells rows apart even where they repeat a page_id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{row}{suffix}')}>"


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP chunked framing."""
    out = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are ignored.

    Raises ValueError on a broken frame.
    """
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is cut")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("negative chunk size")
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def info_record(task: int) -> bytes:
    """The record that describes the archive."""
    return _record(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(f"{task}/info")), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")],
        b"software: pagewright\r\nformat: WARC File Format 1.0\r\n",
    )


def build_records(row: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, segment: int, chunk: int, refers_url: str | None = None) -> list[bytes]:
    """A page as one response or revisit record, or as segments of a response."""
    own = record_id(row)
    spelled = lambda u: (u or "").replace("\r", "%0D").replace("\n", "%0A")
    target = spelled(url)
    common = [
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        extra = [kind, ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", spelled(refers_url)), ("WARC-Refers-To-Date", _DATE), ("X-Refers-To-Page", str(refers_to))]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *extra], b"HTTP/1.1 200 OK\r\n\r\n")]
    block = _HTTP_HEAD + chunked(payload, chunk)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, kind], block)]
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", "1"), *common, kind], pieces[0])]
    for number, piece in enumerate(pieces[1:], 2):
        headers = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", record_id(row, f"/{number}")),
            ("WARC-Segment-Origin-ID", own),
            ("WARC-Segment-Number", str(number)),
            ("WARC-Date", _DATE),
            ("WARC-Target-URI", target),
        ]
        if number == len(pieces):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(headers, piece))
    return out


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record of an archive file."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("record header is cut")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(headers["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError("record block is cut")
        yield headers, block
        at = end + 4 + length


def _payload_keys(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, key) of the rows that may be revisits; key: hex SHA-1 of a payload of at least ``min_bytes``."""
    payload = _payload(F.col("html"))
    return pages.filter((F.octet_length(payload) >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", F.sha1(payload).alias("key"))


def mark_revisits(keyed: DataFrame) -> DataFrame:
    """(page_id, key, refers_to, refers_url) of the rows whose payload a smaller page_id already has.

    Of the pages of one key the smallest page_id is the response. Groups are pre-aggregated, and a payload that many pages
    share is dealt to several tasks; only keys travel, never payloads.
    """
    firsts = keyed.groupBy("key").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    named = firsts.select("key", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    marked = skew_join(keyed.select("page_id", "key"), named, ["key"], firsts, keyed.count())
    return marked.filter("page_id <> refers_to").select("page_id", "key", "refers_to", "refers_url").distinct()


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = 16 << 10, chunk: int = 4 << 10, per_file: int = 2_000) -> None:
    """Write a WARC record per row of (page_id, url, html) to gzip files under ``path``.

    Edge cases: a null page is the empty payload; a null URL an empty target; a row with a
    null page_id is always a response; of several rows with the same page_id and payload
    each is written. An empty table writes an empty folder. No file holds more than
    ``per_file`` segments.
    """
    keyed = stored(_payload_keys(pages, min_bytes), "warc-keys")
    revisits = stored(mark_revisits(keyed), "warc-revisits")
    rows = pages.select("page_id", "url", _payload(F.col("html")).alias("payload"), F.sha1(_payload(F.col("html"))).alias("key"))
    rows = rows.join(small_side(revisits), ["page_id", "key"], "left").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        out = [info_record(task)]
        for batch in text_batches(batches):
            columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("page_id", "url", "payload", "refers_to", "refers_url"))
            for p, u, data, f, other in zip(*columns):
                count += 1
                out += build_records(f"{task}/{count}", p, u, data, base32_sha1(data), f, segment, chunk, other)
            yield pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in out], pa.binary())], ["record"])  # the writer adds the last line feed
            out = []

    records = rows.mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    release(keyed, revisits)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every response and revisit of the archives, whole: page_id, url, payload, payload_digest, record_type, refers_to, payload_bytes.

    Raises, through the task, on a cut record, a missing or repeated segment, a wrong total
    length, a broken chunk frame, a digest or length that the payload does not have, or a revisit that names no
    response of its digest and length.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt.gz").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                held = 0
                for headers, block in parse_archive(gzip.decompress(content.as_py())):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    origin = headers.get("warc-segment-origin-id")
                    number = int(headers.get("warc-segment-number", "0"))
                    total = headers.get("warc-segment-total-length")
                    page = headers.get("x-page-id")
                    refers = headers.get("x-refers-to-page")
                    out.append(
                        (
                            origin or headers["warc-record-id"],
                            number,
                            int(total) if total else None,
                            headers["warc-type"],
                            int(page) if page else None,
                            headers.get("warc-target-uri"),
                            headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                            int(refers) if refers else None,
                            int(headers["x-payload-length"]) if "x-payload-length" in headers else None,
                            block,
                        )
                    )
                    held += len(block)
                    if held > 8 << 20:
                        yield _segments(out)
                        out, held = [], 0
                yield _segments(out)

    segments = files.mapInArrow(
        parse, "origin string, number int, total long, type string, page_id long, url string, digest string, refers_to long, length long, block binary"
    )
    parsed = stored(segments, "warc-segments")
    facts = ("page_id", "url", "digest", "type", "refers_to", "length")
    whole = parsed.filter("number = 0 AND type = 'response'").select("origin", *facts, "total", F.array(F.struct("number", "block")).alias("parts"))
    # Only split records are shuffled; a group is one record, so its size is bound by the longest page.
    split = parsed.filter("number > 0").groupBy("origin")
    first = (F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in facts)
    joined = split.agg(*first, F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            payloads = [
                _decoded(*row) for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("origin", "parts", "total", "digest", "length")))
            ]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("page_id", "url", "digest", "type", "refers_to")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(map(len, payloads), pa.int64()), pa.array(payloads, pa.binary())],
                ["page_id", "url", "payload_digest", "record_type", "refers_to", "payload_bytes", "payload"],
            )

    responses = whole.unionByName(joined).mapInArrow(
        decode, "page_id long, url string, payload_digest string, record_type string, refers_to long, payload_bytes long, payload binary"
    )
    return responses.unionByName(_checked_revisits(parsed))


def _decoded(origin: str, parts: list[dict], total: int | None, digest: str, length: int | None) -> bytes:
    """The payload of a record's segments."""
    if parts[0]["number"] != 0 and ([p["number"] for p in parts] != list(range(1, len(parts) + 1)) or sum(len(p["block"]) for p in parts) != total):
        raise ValueError(f"segments do not make up record {origin}")
    head, _, body = b"".join(p["block"] for p in parts).partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if base32_sha1(payload) != digest or length not in (None, len(payload)):
        raise ValueError(f"the payload of record {origin} does not have its digest or length")
    return payload


def _checked_revisits(parsed: DataFrame) -> DataFrame:
    """The revisits, each held against the response that it names; responses' own digests and lengths are held against their payloads."""
    revisits = parsed.filter("type = 'revisit'").select("page_id", "url", "digest", "refers_to", "length")
    named = parsed.filter("type = 'response' AND number <= 1").select(F.col("page_id").alias("refers_to"), "digest", F.col("length").alias("whole")).distinct()
    counted = revisits.groupBy("refers_to", "digest").agg(F.count(F.lit(1)).alias("rows"))
    met = skew_join(revisits, named, ["refers_to", "digest"], counted, revisits.count(), "left")
    complaint = F.raise_error(F.concat(F.lit("no response of the digest and length of the revisit of page "), F.coalesce(F.col("refers_to").cast("string"), F.lit("?"))))
    size = F.when(F.col("length") == F.col("whole"), F.col("length")).otherwise(complaint.cast("long"))
    return met.select(
        "page_id", "url", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", size.alias("payload_bytes"), F.lit(None).cast("binary").alias("payload")
    )


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["origin", "number", "total", "type", "page_id", "url", "digest", "refers_to", "length", "block"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, and remove the files."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, min_bytes)
    out = read_archives(spark, path)  # has parsed all files by now
    remove(spark, path)
    return out
