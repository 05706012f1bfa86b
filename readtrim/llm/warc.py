"""WARC archives: write segmented records, read them back, reassemble segments and decode chunked framing.

Writing. Each task writes one gzip member per record into archive files of its own (a fresh name per attempt) in the
given folder and returns a manifest row per archive; the manifest is committed by Spark, so archives of failed or
repeated attempts are simply not in it. Bodies are HTTP/1.1 responses with chunked framing; records longer than
SEGMENT are cut into a first record and continuations with WARC-Segment-Origin-ID and -Number, the last with
WARC-Segment-Total-Length.

Reading. One task reads one archive of bounded size (ARCHIVE bytes, more only if one record is longer). Whole records are
decoded where they are read. Only segments are shuffled: grouped by origin identifier (a group is one record, never
more), ordered by number, checked for gaps, conflicts and the total length, joined, then decoded.

Duplicates: of records with equal payloads the one with the largest id is the response, the others are revisits.

Edge cases: a null payload is an empty one; repeated rows are records of their own (those that share the largest id
are all responses); a null id is kept and never the response if the group has another; null urls have no target
header; extra columns are ignored. Segments that repeat with equal bytes count once; with different bytes the record's
status is ``conflict``, with a missing one ``missing segment``, with a wrong length ``wrong length``, with bad framing
``bad chunks``: such records come out with their status and no payload.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, materialize, new_path, parted

SEGMENT, ARCHIVE, FRAME = 1 << 16, 32 << 20, 8192
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of 40 hexadecimal digits (a SHA-1): five digits are four letters."""
    group = lambda g: F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
    letters = [
        F.substring(F.lit(_ALPHABET), F.shiftright(group(g), 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in range(8) for j in range(4)
    ]
    return F.concat(*letters)


def chunked(body: bytes, size: int = FRAME) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[k : k + size]), body[k : k + size]) for k in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The body of a chunked message; extensions and trailers are skipped. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        head = data[at:end].split(b";")[0].strip()
        if not head or any(c not in b"0123456789abcdefABCDEF" for c in head):
            raise ValueError("bad chunk size")
        n, at = int(head, 16), end + 2
        if n == 0:
            break
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("bad chunk end")
        out.append(data[at : at + n])
        at += n + 2
    while data[at : at + 2] != b"\r\n":  # trailers
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no end")
        at = end + 2
    return b"".join(out)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in headers if v is not None]
    return b"".join((b"WARC/1.1\r\n", "".join(lines).encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"))


def records_of(page_id, url: str | None, payload: bytes, digest: str, refers_to, record_id: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The record or records of one page; a revisit has the response's head and no body."""
    clean = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    revisit = refers_to is not None
    own = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("X-Refers-To-Page-ID", str(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    block = head if revisit else head + chunked(payload)
    if len(block) <= segment:
        yield record(own, block)
        return
    cuts = [block[k : k + segment] for k in range(0, len(block), segment)]
    yield record([*own, ("WARC-Segment-Number", "1")], cuts[0])
    for n, cut in enumerate(cuts[1:], 2):
        yield record(
            [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.UUID(record_id[10:-1]), str(n))}>"),
                ("WARC-Date", "1970-01-01T00:00:00Z"),
                ("WARC-Segment-Origin-ID", record_id),
                ("WARC-Segment-Number", str(n)),
                ("WARC-Segment-Total-Length", str(len(block)) if n == len(cuts) else None),
            ],
            cut,
        )


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and last:
                headers[last] += " " + text.strip()
                continue
            last, _, value = text.partition(":")
            last = last.strip().lower()
            headers[last] = value.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("truncated record")
        yield headers, block


def decode_http(block: bytes) -> bytes:
    """The payload of an HTTP response: after the head, with chunked framing taken off."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no HTTP head")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, payload, digest, refers_to); the manifest (path, records, bytes)."""

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, made = None, "", 0, []
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)

        def close() -> None:
            data = out.getvalue()
            with store.open_output_stream(path, compression=None) as f:
                f.write(data)
            made.append({"path": path, "records": n, "bytes": len(data)})

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out, path, n = io.BytesIO(), f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                page_id, url, payload, digest, refers_to = row
                rid = f"<urn:uuid:{uuid.uuid4()}>"
                for r in records_of(page_id, url, payload or b"", digest, refers_to, rid, segment):
                    out.write(gzip.compress(r, 6, mtime=0))
                    n += 1
                if out.tell() >= archive:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(made, pa.schema({"path": pa.string(), "records": pa.int64(), "bytes": pa.int64()}))

    return materialize(
        pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(put, "path string, records long, bytes long"), "manifest"
    )


_RAW = "origin string, number int, total long, type string, page_id string, url string, digest string, refers_to string, length long, block binary"


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the manifest's archives after reassembly: type, page_id, url, digest, refers_to, payload, status."""
    schema = pa.schema({
        "origin": pa.string(), "number": pa.int32(), "total": pa.int64(), "type": pa.string(), "page_id": pa.string(),
        "url": pa.string(), "digest": pa.string(), "refers_to": pa.string(), "length": pa.int64(), "block": pa.binary(),
    })

    def raw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as f, gzip.open(f) as unzipped:
                    for h, block in parse(unzipped):
                        segmented = "warc-segment-number" in h
                        if h.get("warc-type") not in ("response", "revisit", "continuation"):
                            continue
                        rows.append({
                            "origin": (h.get("warc-segment-origin-id") or h["warc-record-id"]) if segmented else None,
                            "number": int(h["warc-segment-number"]) if segmented else None,
                            "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                            "type": h["warc-type"], "page_id": h.get("x-page-id"), "url": h.get("warc-target-uri"),
                            "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            "refers_to": h.get("x-refers-to-page-id"),
                            "length": int(h["x-payload-length"]) if "x-payload-length" in h else None, "block": block,
                        })
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = max(1, manifest.count())
    records = manifest.select("path").repartition(min(files, 100_000)).mapInArrow(raw, _RAW)
    records = materialize(records, "records")  # read once, used for whole records and for segments
    whole = records.where("number is null").withColumn("status", F.lit("ok")).drop("origin", "number", "total")
    return decode(whole.unionByName(reassemble(records.where("number is not null"))))


def reassemble(segments: DataFrame) -> DataFrame:
    """One row per origin: its first segment's headers, the joined block, and a status."""
    seg = F.col("s")
    head = F.struct(*[F.col(c) for c in ("type", "page_id", "url", "digest", "refers_to", "length")])
    # a segment that is there twice with equal bytes counts once
    grouped = segments.groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("number", "block"))).alias("s"),
        F.max("total").alias("total"),
        F.min("total").alias("least_total"),
        F.min_by(head, "number").alias("h"),
        F.min("number").alias("first"),
    )
    n = F.size(seg)
    numbers = F.transform(seg, lambda x: x["number"])
    size = F.aggregate(seg, F.lit(0).cast("long"), lambda a, x: a + F.length(x["block"]))
    status = (
        F.when(F.size(F.array_distinct(numbers)) < n, "conflict")
        .when((F.col("first") != 1) | (F.element_at(numbers, -1) != n) | F.col("total").isNull(), "missing segment")
        .when((F.col("total") != size) | (F.col("least_total") != F.col("total")), "wrong length")
        .otherwise("ok")
    )
    # hexadecimal is the one way in which built-in functions join an array of binaries
    joined = F.unhex(F.array_join(F.transform(seg, lambda x: F.hex(x["block"])), ""))
    return grouped.select("h.*", F.when(status == "ok", joined).alias("block"), status.alias("status"))


def decode(records: DataFrame) -> DataFrame:
    """``block`` to ``payload`` (the body without its framing; none for revisits)."""

    def body(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("block")
            kinds, status = b.column(b.schema.get_field_index("type")).to_pylist(), b.column(b.schema.get_field_index("status")).to_pylist()
            payload = []
            for k, block in enumerate(b.column(at).to_pylist()):
                found = None
                if block is not None and status[k] == "ok" and kinds[k] != "revisit":
                    try:
                        found = decode_http(block)
                    except ValueError:
                        status[k] = "bad chunks"
                payload.append(found)
            names = ["type", "page_id", "url", "digest", "refers_to", "length"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(payload, pa.binary()), pa.array(status, pa.string())],
                names=[*names, "payload", "status"],
            )

    return records.mapInArrow(body, "type string, page_id string, url string, digest string, refers_to string, length long, payload binary, status string")


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses) of ``pages`` (page_id, url, html)."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", base32_of_hex(F.sha1("payload")))
    # Only payloads in the hash slots of those that occur twice are joined, and one of a third of all rows is dealt into parts.
    first = rows.groupBy("digest").agg(F.max("page_id").alias("__first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first, "firsts")
    clear, doubtful = parted(rows, first, "digest")
    joined = dealt_join(doubtful, first, "digest", "page_id", "left")
    refers = F.when(F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col("page_id")), F.col("__first"))
    none = F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to")
    return joined.select(*rows.columns, refers.alias("refers_to")).unionByName(clear.select(*rows.columns, none))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages, read them back, and give each record's row; see the module's text for the cases."""
    spark: SparkSession = pages.sparkSession
    folder = new_path(spark, "warc")
    manifest = write(with_revisits(pages), folder)
    back = read(manifest, folder)
    kind = pages.schema["page_id"].dataType
    return back.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
        "url",
        "digest",
        "length",
        "payload",
        "status",
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """Per page: payload_bytes, payload_digest, record_type and refers_to as read back.

    A response's figures are those of its decoded payload; a revisit has none, its own come from its headers.
    """
    back = archive_and_read(pages)
    response = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(response, base32_of_hex(F.sha1("payload"))).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hexed FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(hexed, 5 * (k // 4) + 1, 5) AS INT) >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') AS payload_digest
      FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, cast(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM m
"""

__all__ = ["archive_and_read", "chunked", "page_rows", "parse", "read", "reassemble", "unchunked", "write"]
