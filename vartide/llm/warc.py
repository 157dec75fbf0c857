"""WARC archives: write, read back, and reassemble segmented records.

Writing: one record per page; blocks longer than `segment_bytes` become a first segment and
`continuation` records. HTTP bodies are framed with chunked transfer coding. Tasks bundle records up to
`file_bytes` (segments keep any record below that) and Spark's text sink puts each bundle into a gzip file
of its own, so tasks commit or retry as usual and a file always fits a task.
Reading: every file is parsed into records by Content-Length; the segments of a record are grouped
by origin identifier, ordered by segment number, held against the announced total length, and the
body is decoded from its chunks.

Defined cases: null html is an empty payload; null url gives the record's own identifier as target;
null page_id gives a record whose identifier carries none (page_id comes back null) and such rows
never become the record that others refer to; repeated rows each give a record; an empty table
gives no records; extra input columns, whatever their names, are ignored; very long pages are segmented, and
a record's segments meet in one task; of equal payloads whose largest page_id repeats, every row of that
page_id is a response. A record with missing or surplus segments, or
with a wrong total length, comes back with `complete` false and a null payload.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.llm import common

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_duplicates(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Add payload, payload_bytes, payload_digest (SHA-1 hex), record_type and refers_to.

    Of equal payloads of at least min_bytes the largest page_id is the response. Only digests that
    occur more than once are joined, on the digest; adaptive execution splits a hot one."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    winners = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("winner"), F.count("*").alias("copies"))
        .filter("copies > 1 and winner is not null")
        .select("payload_digest", "winner")
    )
    # a table: between two plain exchanges the join can split a hot digest
    joined = rows.join(common.materialize(winners, "winners"), "payload_digest", "left")
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("winner")).alias("refers_to"),
    )


def _chunked(body: bytes, chunk_bytes: int) -> bytes:
    parts = []
    for i in range(0, len(body), chunk_bytes):
        piece = body[i : i + chunk_bytes]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def decode_chunked(framed: bytes) -> bytes:
    """The body behind chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";", 1)[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(framed[end + 2 : end + 2 + size])
        if len(out[-1]) != size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk shorter than announced")
        at = end + 4 + size


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def record_id(page_id, digest: str) -> str:
    """The identifier of a page's record: the page and its payload, so that repeated page_ids stay apart."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def page_records(page_id, url, payload: bytes, digest: str, record_type: str, refers_to, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, each without the closing blank lines."""
    me = record_id(page_id, digest)
    target = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) if url else me.strip("<>")
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", me), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if record_type == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        yield _record([*fields, ("Content-Type", "application/http;msgtype=response")], http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + _chunked(payload, chunk_bytes)
    fields.append(("Content-Type", "application/http;msgtype=response"))
    n = -(-len(block) // segment_bytes)
    if n == 1:
        yield _record(fields, block)
        return
    for k in range(n):
        piece = block[k * segment_bytes : (k + 1) * segment_bytes]
        if k == 0:
            yield _record([*fields, ("WARC-Segment-Number", "1")], piece)
        else:
            more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{me[:-1]}:{k + 1}>"), fields[2], fields[3], ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(k + 1))]
            yield _record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (k == n - 1), piece)


FILE_BYTES = 32 << 20


def write_archives(marked: DataFrame, path: str, segment_bytes: int = 32768, chunk_bytes: int = 8192, records_per_file: int = 5000, file_bytes: int = FILE_BYTES) -> None:
    """Write what mark_duplicates returns as .gz WARC files under path, of at most records_per_file records and
    about file_bytes each (before compression)."""
    end = b"\r\n\r\n"

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            cols = [b.column(c) for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
            for row in zip(*cols, strict=True):
                for record in page_records(*(x.as_py() for x in row), segment_bytes, chunk_bytes):
                    held.append(record)
                    size += len(record)
                    if size >= file_bytes or len(held) >= records_per_file:
                        yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], ["records"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], ["records"])

    bundles = marked.mapInArrow(frame, "records binary").select(F.col("records").cast("string").alias("value"))
    # a bundle's last closing blank lines are the sink's line separator
    bundles.write.option("lineSep", end.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of one file, gzip members or plain."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def decode_block(record_type: str, block: bytes) -> tuple[bool, int | None, bytes | None]:
    """(sound, payload length, payload; null for revisits) of a record's whole block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    if record_type == "revisit":
        return True, int(fields.get(b"content-length", b"0")), None
    try:
        body = decode_chunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body
    except ValueError:
        return False, None, None
    return True, len(body), body


def join_segments(segments: list[dict]) -> bytes | None:
    """The block of a segmented record; null if a segment is missing or the total length differs.
    A segment that was read more than once (the archive holds the record again) counts once."""
    by_number = {s["segment"]: s for s in segments}
    numbers = sorted(by_number)
    block = b"".join(by_number[k]["block"] for k in numbers)
    whole = numbers == list(range(1, len(numbers) + 1)) and by_number[numbers[-1]]["total_length"] == len(block)
    return block if whole else None


#: What the reader passes on: a record in one piece is decoded already and has segment 0 and no block.
_PART = "segment long, total_length long, record_type string, refers_to string, payload_digest string, payload_bytes long, payload_sha1 string, complete boolean, block binary"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A row per record under path: group_key (its own for a record in one piece, else the origin),
    record_id and _PART. A file is read by one task; `write_archives` bounds its bytes."""
    schema = f"group_key string, record_id string, {_PART}"
    names, types = [x.split()[0] for x in schema.split(", ")], [pa.string(), pa.string(), *_TYPES]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, held = [], 0
                for k, (f, block) in enumerate(parse_archive(data.as_py())):
                    me, kind = f["warc-record-id"], f["warc-type"]
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    segment, total = int(f.get("warc-segment-number", 0)), f.get("warc-segment-total-length")
                    if segment:
                        origin = f.get("warc-segment-origin-id", me)
                        rows.append((origin, me, segment, total and int(total), kind, f.get("warc-refers-to"), digest, None, None, None, block))
                        held += len(block)
                    else:
                        ok, n, body = decode_block(kind, block)
                        rows.append((f"{file}:{k}", me, 0, None, kind, f.get("warc-refers-to"), digest, n, body if body is None else hashlib.sha1(body).hexdigest(), ok, None))
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")
    return files.mapInArrow(parse, schema)


def reassemble(parts: DataFrame) -> DataFrame:
    """One row per logical record: record_id, record_type, refers_to, payload_digest (announced),
    payload_bytes, payload_sha1 (of the decoded body; null for revisits), complete, n_segments.

    Groups hold the segments of one record; records in one piece pass as short rows."""
    schema = "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload_sha1 string, complete boolean, n_segments int"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.int32()]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for segments in b.column("segments").to_pylist():
                first = segments[0]
                n, sha, ok = first["payload_bytes"], first["payload_sha1"], first["complete"]
                if first["segment"]:
                    block = join_segments(segments)
                    ok, n, body = (False, None, None) if block is None else decode_block(first["record_type"], block)
                    sha = None if body is None else hashlib.sha1(body).hexdigest()
                copies = max(1, sum(s["segment"] == first["segment"] for s in segments))
                out += [(first["record_id"], first["record_type"], first["refers_to"], first["payload_digest"], n, sha, ok, len(segments) // copies)] * copies
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    part = F.struct("segment", "record_id", *[x.split()[0] for x in _PART.split(", ")[1:]])
    return parts.groupBy("group_key").agg(F.sort_array(F.collect_list(part)).alias("segments")).select("segments").mapInArrow(finish, schema)


def page_id_of(record_id_column: str):
    """The page_id in a record identifier; null where the page had none."""
    return F.nullif(F.regexp_extract(record_id_column, r"^<urn:x-page:(-?\d*):", 1), F.lit("")).cast("long")
