"""WARC archives written and read by Spark, and transactions assembled from their records."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise

CRLF = "\r\n"
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
#: Bytes of records, before compression, after which a chunk ends, and chunks of a file: a reader's task holds one
#: file of ours, which is bounded by both and at most one capture for each chunk beyond them.
CHUNK, FILE_CHUNKS = 16 << 20, 8
#: Bytes that a reader inflates at once, and records and bytes of blocks that it returns at once.
PIECE, ROWS = 1 << 20, 512
DATE = "2024-01-01T00:00:00Z"


def _urn(*parts: Column) -> Column:
    """A record id from a hash of what tells the record apart, in the form of a UUID."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _record(kind: str, date: str, record_id: Column, headers: list[tuple[str, Column | None]], content_type: str, block: Column) -> Column:
    """The text of one record with the two line ends after it; headers that are null are left out."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {date}{CRLF}WARC-Record-ID: "), record_id, F.lit(CRLF)]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit(CRLF + CRLF))


def revisits(pages: DataFrame) -> DataFrame:
    """Add ``refers_to`` to rows of ``page_id, digest, n_bytes``: the least page_id of an equal payload of enough bytes.

    Only digests meet, never payloads; a payload that very many pages share is counted before the
    shuffle, and its rows are joined back in a join that Spark splits.
    """
    large = pages.where(F.col("n_bytes") >= LEAST_REVISIT)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return large.join(first, "digest").select("page_id", "digest", "refers_to")


def _chunks(batches, compression: str, chunk: int):
    """Captures (request, main, metadata) as chunks of records, each record a gzip member of its own.

    A member ends with the four bytes of its length, the last of which is zero for one of less than
    16 MB as metadata always is: a chunk leaves that byte to the line end of the text sink. Without
    compression the last line end is left to it.
    """

    def packed(record: bytes) -> bytes:
        if compression == "none":
            return record
        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        return deflate.compress(record) + deflate.flush()

    def row(parts):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["value"])

    parts, size = [], 0
    for batch in batches:
        for capture in zip(*batch.columns):
            for record in capture:
                data = record.as_py()
                parts.append(packed(data))
                size += len(data)
            if size >= chunk:
                yield row(parts)
                parts, size = [], 0
    if parts:
        yield row(parts)


def write(pages: DataFrame, path: str, compression: str = "gzip", key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE, chunk: int = CHUNK) -> None:
    """Write a request, a response or revisit, and a metadata record for each page as WARC files under ``path``.

    The record of the least page_id among equal payloads of 100 bytes or more is the response;
    the others revisit it and hold no payload. Null payloads count as empty; null urls and line
    ends in urls are written as ``urn:page`` and percent codes. Rows that repeat a page_id with the
    same payload: one is the response and the others revisit it. Pages without an id are all
    responses. An empty table writes an archive without records; further columns are left out, and
    long payloads are written whole. ``date`` is the time of capture, which pages don't have.
    Payloads don't move: what is decided by digests is joined to them as a written table, which
    Spark broadcasts below its threshold; only rows that repeat both id and payload are numbered.
    """
    if compression not in ("gzip", "none"):
        raise ValueError("compression is gzip (a member for each record) or none")
    text = F.coalesce(F.col(payload), F.lit(""))
    thin = materialise(pages.select(F.col(key).cast("long").alias("page_id"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).where("page_id is not null"), "payloads")
    again = revisits(thin).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct()
    own = thin.groupBy("page_id", "digest").agg(F.count("*").alias("n"))
    marked = own.join(again, (own.page_id == again.p) & (own.digest == again.d), "left").where((F.col("n") > 1) | (F.col("refers_to") != F.col("page_id")))
    marked = materialise(marked.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to", "n"), "marked")
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text.alias("payload"))
    base = base.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "n_bytes": F.octet_length("payload").cast("long")})
    base = base.join(marked, (base.page_id == marked.p) & (base.digest == marked.d), "left").drop("p", "d")
    # nothing refers to a page without an id: any number of its own will do
    alone = F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(1).cast("long"))
    numbered = base.where(F.coalesce("n", F.lit(1)) == 1).withColumn("turn", alone)
    if not marked.where("n > 1").isEmpty():
        turn = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")).cast("long")
        numbered = numbered.unionByName(base.where("n > 1").withColumn("turn", turn))
    is_revisit = F.col("page_id").isNotNull() & F.col("refers_to").isNotNull() & ((F.col("refers_to") != F.col("page_id")) | (F.col("turn") > 1))
    name = [F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest", F.col("turn").cast("string")]
    main = _urn(F.lit("response"), *name)
    target = F.coalesce(F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A"), F.concat(F.lit("urn:page:"), F.col("page_id").cast("string")), F.lit("urn:page:none"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    request = _record("request", date, _urn(F.lit("request"), *name), [("WARC-Target-URI", target), ("WARC-Concurrent-To", main)], "application/http;msgtype=request", F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    response = _record("response", date, main, [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest)], "application/http;msgtype=response", F.concat(head, F.col("payload")))
    first_id = _urn(F.lit("response"), F.col("refers_to").cast("string"), "digest", F.lit("1"))
    revisit = _record("revisit", date, main, [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", first_id)], "application/http;msgtype=response", head)
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")))
    metadata = _record("metadata", date, _urn(F.lit("metadata"), *name), [("WARC-Target-URI", target), ("WARC-Concurrent-To", main)], "application/warc-fields", fields)
    captures = numbered.select(request.cast("binary").alias("a"), F.when(is_revisit, revisit).otherwise(response).cast("binary").alias("b"), metadata.cast("binary").alias("c"))
    chunks = captures.mapInArrow(lambda batches: _chunks(batches, compression, chunk), "value binary").select(F.col("value").cast("string"))
    chunks.write.option("lineSep", "\0" if compression == "gzip" else "\n").option("compression", "none").option("maxRecordsPerFile", FILE_CHUNKS).text(path)


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a file that comes in pieces, inflated if it is one or more gzip members; ``PIECE`` bytes at once at most."""
    inflate, begun, zipped = None, b"", None
    for piece in pieces:
        if zipped is None:
            begun += bytes(piece)
            if len(begun) < 2:
                continue
            zipped, piece = begun[:2] == b"\x1f\x8b", begun
        if not zipped:
            yield bytes(piece)
        while zipped and len(piece):
            inflate = inflate or zlib.decompressobj(31)
            out = inflate.decompress(piece, PIECE)
            if out:
                yield out
            piece = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            inflate = None if inflate.eof else inflate
    if inflate:
        while out := inflate.decompress(inflate.unconsumed_tail, PIECE):
            yield out
        if not inflate.eof:
            raise ValueError("the archive ends inside a gzip member")
    if zipped is None and begun:
        yield begun


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(version, headers with lower-case names, block) of each record of a WARC file that comes in pieces, gzip or not.

    No more than a record and a piece is held. A file that ends inside a record, or bytes that begin
    no record, raise ValueError.
    """
    buffer, source, passed = bytearray(), inflated(pieces), 0

    def more() -> bool:
        piece = next(source, None)
        buffer.extend(piece or b"")
        return piece is not None

    while True:
        while not (kept := buffer.lstrip(b"\r\n")) and more():
            pass
        passed += len(buffer) - len(kept)
        del buffer[: len(buffer) - len(kept)]
        if not buffer:
            return
        while len(buffer) < 5 and more():
            pass
        if not buffer.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {passed}")
        end = buffer.find(b"\r\n\r\n")
        while end < 0:
            at = max(0, len(buffer) - 3)
            if not more():
                raise ValueError("the archive ends inside the head of a record")
            end = buffer.find(b"\r\n\r\n", at)
        version, *lines = bytes(buffer[:end]).decode("utf-8").split("\r\n")
        headers: dict[str, str] = {}
        for line in lines:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        stop = end + 4 + int(headers["content-length"])
        while len(buffer) < stop:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield version, headers, bytes(buffer[end + 4 : stop])
        passed += stop
        del buffer[:stop]


RECORD = "record_id string, type string, concurrent_to string, refers_to_record string, target_uri string, date string, content_type string, payload_digest string, payload_bytes long, fields map<string,string>"


def read(spark: SparkSession, path: str, with_block: bool = False) -> DataFrame:
    """One row per record of the archives under a path; blocks only if asked for, so that they needn't move.

    ``payload_bytes`` and ``payload_digest`` (SHA-256, hex) of a response are those of the payload
    read, after the HTTP head; a revisit has no payload of its own and gives the digest it declares.
    Archives named ``*.gz`` are read as a stream by one task each, whatever their size. Others, such
    as the bounded files that ``write`` makes, are inflated piece by piece from the file's bytes,
    which a task holds (Spark reads files of up to 2 GB so).
    """
    kinds = [pa.string()] * 8 + [pa.int64(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * with_block
    names = [c.split()[0] for c in RECORD.replace("map<string,string>", "map").split(", ")] + ["block"] * with_block

    def rows_of(files: Iterable[Iterable[bytes]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for pieces in files:
            for _, h, block in parse(pieces):
                kind, digest, n, fields = h.get("warc-type"), None, None, None
                if kind == "response":
                    body = memoryview(block)[block.find(b"\r\n\r\n") + 4 :] if "http" in h.get("content-type", "") else memoryview(block)
                    digest, n = hashlib.sha256(body).hexdigest(), len(body)
                elif kind == "revisit":
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                elif h.get("content-type") == "application/warc-fields":
                    fields = [(n.strip(), v.strip()) for n, s, v in (line.partition(":") for line in block.decode("utf-8").split("\r\n")) if s]
                rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), digest, n, fields) + ((block,) if with_block else ()))
                size += len(block) * with_block
                if len(rows) >= ROWS or size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    def whole(batches):
        def pieces(content):
            data = memoryview(content.as_buffer())
            return (data[at : at + PIECE] for at in range(0, len(data), PIECE))

        yield from rows_of(pieces(content) for batch in batches for content in batch.column(0))

    def streamed(batches):
        lines = ((file, line.as_py()) for batch in batches for file, line in zip(batch.column(0).to_pylist(), batch.column(1)))
        yield from rows_of((line + b"\n" for _, line in own) for _, own in groupby(lines, key=lambda x: x[0]))

    schema = RECORD + (", block binary" if with_block else "")
    nested = {"recursiveFileLookup": "true"}
    files = spark.read.format("binaryFile").options(**nested, pathGlobFilter="{*[^z],*[^g]z,*[^.]gz}").load(path).select("content")
    zipped = spark.read.options(**nested, pathGlobFilter="*.gz", lineSep="\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return files.mapInArrow(whole, schema).unionByName(zipped.mapInArrow(streamed, schema))


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the structs ``request``, ``response`` (or revisit) and ``metadata``, and the record it refers to.

    Requests and metadata meet their capture by its record id, which they name as concurrent; a
    capture without one of them has null there, and records that name no capture are left out. A
    revisit is joined to the response that it refers to. Requests or metadata that repeat give the
    least by record id.
    """
    row = F.struct(*[c for c in records.columns if c not in ("type", "concurrent_to")])

    def beside(kind: str) -> DataFrame:
        own = records.where(F.col("type") == kind).select(F.col("concurrent_to").alias(f"_{kind}"), F.col("record_id").alias("_id"), row.alias(kind))
        return own.groupBy(f"_{kind}").agg(F.min_by(kind, "_id").alias(kind))

    main = records.where(F.col("type").isin("response", "revisit")).select("record_id", "type", "refers_to_record", row.alias("response"))
    page = lambda fields: F.element_at(F.col(fields), "page-id").cast("long")
    named = records.where("type = 'metadata'").groupBy("concurrent_to").agg(F.min_by("fields", "record_id").alias("fields")).select(F.col("concurrent_to").alias("_of"), page("fields").alias("refers_to"))
    kept = records.where("type = 'response'").select(F.col("record_id").alias("_first"), F.struct("target_uri", "payload_digest", "payload_bytes").alias("first"))
    kept = kept.join(named, kept._first == named._of, "left").drop("_of")
    out = main
    for kind in ("request", "metadata"):
        side = beside(kind)
        out = out.join(side, out.record_id == side[f"_{kind}"], "left").drop(f"_{kind}")
    # captures that revisit nothing have a null here, which never meets: only revisits move to it
    out = out.join(kept, out.refers_to_record == kept._first, "left").drop("_first", "refers_to_record")
    return out.withColumn("page_id", page("metadata.fields"))
