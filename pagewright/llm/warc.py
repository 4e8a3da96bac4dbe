"""WARC archives: pages as chunked, segmented records, and whole payloads put together from archives again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as S

from pagewright.session import ensure_checkpoint_dir, write_through

#: Bytes of a record's block; longer ones go on in continuation records.
SEGMENT_BYTES = 1 << 14
#: Bytes of payload in a chunk of the transfer framing.
CHUNK_BYTES = 1 << 12
#: Records in an archive file at most, so no file has over 64 MiB of blocks.
FILE_RECORDS = 4096
#: Bytes of records that a task gathers before it hands them on.
BATCH_BYTES = 1 << 22
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Named fields of a record that are kept, beside the columns they go to.
FIELDS = {
    b"warc-record-id": "id", b"warc-type": "type", b"warc-target-uri": "target", b"page-id": "page", b"warc-segment-number": "segment", b"warc-segment-origin-id": "origin",
    b"warc-segment-total-length": "total", b"warc-payload-digest": "digest", b"refers-to-page-id": "refers",
}
RECORD = "id string, type string, target string, page string, segment long, origin string, total long, digest string, refers string, block binary, defect string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The pieces of a payload's chunked transfer framing."""
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        yield b"%x\r\n" % len(piece)
        yield piece
        yield b"\r\n"
    yield b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, extensions and trailers left out; NULL if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";", 1)[0].strip() if end >= 0 else b""
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return None
        size, at = int(digits, 16), end + 2
        if not size:
            # Trailer lines end with an empty one.
            return b"".join(out) if body.startswith(b"\r\n", at) or body.endswith(b"\r\n\r\n") else None
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response block; NULL if it can't be told."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return None
    framed = any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    return dechunked(body) if framed else body


def written_record(fields: dict[str, str], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n%s\r\n%s" % (f"{head}Content-Length: {len(block)}\r\n".encode(), block)


def segments(fields: dict[str, str], block: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """A record, cut into a first segment and continuation records if its block is longer than ``size`` bytes."""
    if len(block) <= size:
        yield written_record(fields, block)
        return
    count = -(-len(block) // size)
    for n in range(1, count + 1):
        own = {**fields, "WARC-Segment-Number": str(n)}
        if n > 1:
            own = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": fields["WARC-Date"], "WARC-Target-URI": fields["WARC-Target-URI"],
                   "WARC-Segment-Origin-ID": fields["WARC-Record-ID"], "WARC-Segment-Number": str(n), "WARC-Segment-Total-Length": str(len(block)) if n == count else None}
        yield written_record(own, block[(n - 1) * size : n * size])


def _keys(body: Column) -> list[Column]:
    """What tells payloads apart: length, SHA-1 and another hash, as SHA-1 alone can be made to collide."""
    return [S.octet_length(body).cast("long").alias("_bytes"), S.sha1(body).alias("_sha1"), S.xxhash64(body).alias("_hash")]


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", path: str | None = None, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
) -> str:
    """Write a WARC record for every page and return the folder of the archives, gzip files of at most 4,096 records.

    Of pages with equal payloads of ``min_bytes`` or more, the one with the largest id is a response and the others are
    revisits that name it; smaller payloads are responses all. A response's block is an HTTP head and the chunked payload;
    blocks over ``segment_bytes`` go on in continuation records. NULL bodies are empty payloads. Rows that are repeated
    with their id are responses each, or revisits each. A NULL id is the smallest. Bodies move once, by id
    and digest, and those of revisits are not written. Empty tables give a folder without records.
    """
    spark = pages.sparkSession
    if path is None:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/archives-{uuid.uuid4().hex}"
    body = S.coalesce(S.col(f"`{body_col}`"), S.lit("")).cast("binary")
    own = pages.select(S.col(f"`{id_col}`").alias("page"), S.col(f"`{url_col}`").alias("url"), body.alias("body"))
    same = ["_bytes", "_sha1", "_hash"]
    narrow = write_through(own.select("page", "url", *_keys(S.col("body"))))
    # Written, so that adaptive execution can split a digest that many pages share.
    last = write_through(narrow.groupBy(*same).agg(S.max(S.struct("page", "url")).alias("last")).select(*same, S.col("last.page").alias("last"), S.col("last.url").alias("last_url")))
    small = S.col("_bytes") < min_bytes
    revisits = narrow.join(last, same).filter(~S.col("page").eqNullSafe(S.col("last")) & ~small)
    bodies = own.select("*", *_keys(S.col("body")))
    keys = last.select("last", *[S.col(c).alias(f"k{c}") for c in same])
    found = [S.col("page").eqNullSafe(S.col("last")), *[S.col(c) == S.col(f"k{c}") for c in same]]
    chosen = bodies.filter(~small).join(keys, found).select("page", "url", "body")
    if min_bytes > 0:
        chosen = chosen.unionByName(bodies.filter(small).select("page", "url", "body"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def records(batches):
        import re

        import pyarrow as pa

        def uri(url, page):
            return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"

        def each():
            for part in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
                for page, url, body, digest, refers, refers_url in zip(*(c.to_pylist() for c in part.columns)):
                    fields = {"WARC-Type": "response" if body is not None else "revisit", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Target-URI": uri(url, page), "Page-ID": page}
                    if body is not None:
                        fields |= {"WARC-Payload-Digest": f"sha1:{payload_digest(body)}", "Content-Type": "application/http; msgtype=response"}
                        yield from segments(fields, HTTP_HEAD + b"".join(chunked(body, chunk_bytes)), segment_bytes)
                    else:
                        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Payload-Digest": f"sha1:{digest}", "Refers-To-Page-ID": refers, "WARC-Refers-To-Target-URI": uri(refers_url, refers)}
                        yield written_record(fields, b"")

        for rows in gathered(each(), len):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    text = lambda c: S.col(c).cast("string").alias(c)
    none = lambda c, kind: S.lit(None).cast(kind).alias(c)
    full = chosen.select(text("page"), "url", "body", none("digest", "string"), none("refers", "string"), none("refers_url", "string"))
    # 160 bits are 32 signs of 5 bits; five hex digits are four of them.
    base32 = S.concat(*[S.lpad(S.conv(S.substring("_sha1", 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    again = revisits.select(
        text("page"), "url", none("body", "binary"), S.translate(base32, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567").alias("digest"),
        S.col("last").cast("string").alias("refers"), S.col("last_url").alias("refers_url"),
    )
    made = full.unionByName(again).mapInArrow(records, "record binary").select(S.col("record").cast("string"))
    made.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


def gathered(items, size, most: int = BATCH_BYTES) -> Iterator[list]:
    """Items in lists of about ``most`` bytes."""
    rows, held = [], 0
    for x in items:
        rows.append(x)
        held += size(x) + 64
        if held >= most:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def archive_records(content: bytes) -> Iterator[dict]:
    """The records of an archive, plain or of gzip members; a rest that can't be read is one record with a defect."""
    import zlib

    def pieces():
        if not content.startswith(b"\x1f\x8b"):
            yield content
            return
        rest = content
        while rest.startswith(b"\x1f\x8b"):
            member = zlib.decompressobj(31)
            for at in range(0, len(rest), BATCH_BYTES):
                piece, tail = rest[at : at + BATCH_BYTES], b""
                while piece:
                    yield member.decompress(piece, BATCH_BYTES)
                    piece = member.unconsumed_tail
                if member.eof:
                    tail = member.unused_data + rest[at + BATCH_BYTES :]
                    break
            if not member.eof:
                raise ValueError("cut short")
            rest = tail

    held, source, defect = bytearray(), pieces(), None

    def more() -> bool:
        nonlocal defect
        try:
            held.extend(next(source))
            return True
        except StopIteration:
            return False
        except (zlib.error, ValueError):
            defect = "compression"
            return False

    while True:
        at = 0  # records are taken from the front; what was read is dropped once per record that needs more bytes
        while True:
            while (end := held.find(b"\r\n\r\n", at)) < 0 and more():
                pass
            if end < 0:
                if defect or bytes(held[at:]).strip(b"\r\n"):
                    yield {"defect": defect or "head"}
                return
            lines = bytes(held[at:end]).split(b"\r\n")
            named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
            length = named.get(b"content-length", b"")
            if not lines[0].startswith(b"WARC/1.") or not length.isdigit():
                yield {"defect": "head"}
                return
            first, size = end + 4, int(length)
            while len(held) < first + size and more():
                pass
            if len(held) < first + size:
                yield {"defect": defect or "length"}
                return
            out = {c: named[f].decode("utf-8", "replace") for f, c in FIELDS.items() if f in named}
            yield out | {"block": bytes(held[first : first + size]), "defect": None}
            at = first + size
            while len(held) < at + 4 and more():
                pass
            at += 4
            if at >= BATCH_BYTES:
                break
        del held[:at]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files under a path, in any order: one row a record, its block as stored.

    A file is read by one task, so archives are to stay well under an executor's memory, as written ones do. Where a file
    can't be read on, its last row has a ``defect`` and nothing else.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]

    def parse(batches):
        import pyarrow as pa

        kinds = [pa.int64() if n in ("segment", "total") else pa.binary() if n == "block" else pa.string() for n in names]

        def number(text):
            return int(text) if text and text.isdigit() and len(text) < 19 else None

        def each():
            for batch in batches:
                for content in batch.column(0):
                    for r in archive_records(content.as_buffer().to_pybytes()):
                        digest = r.get("digest")
                        yield r | {"segment": number(r.get("segment")), "total": number(r.get("total")), "digest": digest and digest.removeprefix("sha1:")}

        for rows in gathered(each(), lambda r: len(r.get("block") or b"")):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """(page, target, type, digest, refers, payload, defect): every archived record as a whole.

    Segments are grouped by the record that they continue and put in order; they must be numbered 1, 2, 3, ... without
    a gap or a double, and the total length that the last one names must be theirs. Chunked framing is decoded, and the payload's
    digest must be the stated one. What fails has no payload and a ``defect``: head, length, compression (a
    file's rest), segments, total, framing or digest. Records in one segment are decoded where they are read; only segments move.
    A revisit has no payload of its own. A task holds one record, or one batch, at a time.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]

    def whole(parts: list[dict]) -> dict:
        first = parts[0]
        out = {k: first[k] for k in ("page", "target", "type", "digest", "refers")} | {"payload": None, "defect": first["defect"]}
        if out["defect"] or first["type"] == "revisit":
            return out
        block = first["block"]
        if first["segment"] is not None:
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                return out | {"defect": "segments"}
            block = b"".join(p["block"] for p in parts)
            if parts[-1]["total"] != len(block):
                return out | {"defect": "total"}
        payload = http_payload(block)
        if payload is None:
            return out | {"defect": "framing"}
        digest = payload_digest(payload)
        if out["digest"] not in (None, digest):
            return out | {"defect": "digest"}
        return out | {"payload": payload, "digest": digest}

    def put_together(batches):
        import pyarrow as pa

        shape = {"page": pa.string(), "target": pa.string(), "type": pa.string(), "digest": pa.string(), "refers": pa.string(), "payload": pa.binary(), "defect": pa.string()}

        def each():
            group: list[dict] = []
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    for row in batch.slice(i, 256).to_pylist():
                        origin = row["origin"] or row["id"]
                        if group and (row["segment"] is None or origin is None or origin != group[0]["_origin"]):
                            yield whole(group)
                            group = []
                        group.append(row | {"_origin": origin})
            if group:
                yield whole(group)

        for rows in gathered(each(), lambda r: len(r["payload"] or b"")):
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in shape.items()], list(shape))

    shape = "page string, target string, type string, digest string, refers string, payload binary, defect string"
    parts = records.filter("segment IS NOT NULL").withColumn("_of", S.coalesce("origin", "id"))
    parts = parts.repartition("_of").sortWithinPartitions("_of", "segment", S.expr("type = 'continuation'")).select(*names)
    return records.filter("segment IS NULL").mapInArrow(put_together, shape).unionByName(parts.mapInArrow(put_together, shape))


def archived_payloads(pages: DataFrame, id_col: str = "page_id", **how) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, defect) of every page, archived and read back.

    A revisit's length is that of the response it names, which must have its digest. See ``archive_pages`` for equal
    payloads, NULLs, repeated rows and empty tables, and ``reassemble`` for defects; further columns are not read.
    """
    back = reassemble(read_archives(pages.sparkSession, archive_pages(pages, id_col, **how)))
    back = write_through(back.select("page", "type", "digest", "refers", S.octet_length("payload").cast("long").alias("n"), "defect"))
    kind = pages.schema[id_col].dataType
    full = write_through(back.filter("type = 'response' AND defect IS NULL").groupBy("page", "digest").agg(S.max("n").alias("n")).withColumnsRenamed({"page": "_page", "digest": "_digest", "n": "_n"}))
    again = back.filter("type = 'revisit'").drop("n").join(full, S.col("refers").eqNullSafe(S.col("_page")) & (S.col("digest") == S.col("_digest")), "left")
    rows = back.filter("type <> 'revisit' OR type IS NULL").unionByName(again.select("page", "type", "digest", "refers", S.col("_n").alias("n"), "defect"))
    return rows.select(S.col("page").cast(kind).alias(id_col), S.col("n").alias("payload_bytes"), S.col("digest").alias("payload_digest"), S.col("type").alias("record_type"), S.col("refers").cast(kind).alias("refers_to"), "defect")
