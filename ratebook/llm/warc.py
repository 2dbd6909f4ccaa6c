"""WARC archives with segmented records: written from pages, read back, reassembled and unframed."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, scratch_dir, stored
from .shared_files import write_file

__all__ = ["mark_revisits", "op3_warc", "page_digests", "parse_records", "read_pages", "read_records", "reassemble", "unchunk", "write_warc"]

#: Payloads of fewer bytes are always stored.
MIN_REVISIT_BYTES = 100
#: Longer record blocks are cut into segments of so many bytes.
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
#: A file is closed once it holds so many compressed bytes.
FILE_BYTES = 8_000_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes that the inflater gets at a time.
READ_BYTES = 16_384
RECORD_SCHEMA = "record_id string, record_type string, page_id long, uri string, origin string, segment int, total long, refers_to string, digest string, block binary, n long, sha string"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
RECORD_KINDS = {name: _KINDS[kind] for name, kind in (c.split() for c in RECORD_SCHEMA.split(", "))}


def mark_revisits(pages: DataFrame, id_column: str = "page_id", payload_column: str = "payload", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages with digest (SHA-256 of the payload), first_id and repeat.

    first_id is null for responses, else the smallest id with the same payload; rows that repeat that id are responses too, and
    a null id is never the smallest unless there is no other. repeat numbers the rows that have both id and payload in
    common, from 0, so that it tells all rows apart. Ids and digests are counted once and written; the payloads travel by id and digest only.
    """
    with_digest = pages.withColumn("digest", F.sha2(F.col(payload_column), 256))
    slim = with_digest.select(F.col(id_column).alias("__id"), F.col("digest").alias("__digest"), (F.octet_length(payload_column) >= min_bytes).alias("long"))
    rows = stored(slim.groupBy("__digest", "__id").agg(F.count(F.lit(1)).alias("n"), F.any_value("long").alias("long")), "page-rows")
    first = rows.where("long").groupBy("__digest").agg(F.min("__id").alias("first_id"), F.count(F.lit(1)).alias("ids")).where("ids > 1").drop("ids")
    later = rows.where("long").drop("n", "long").join(stored(first, "page-firsts"), "__digest").where(~F.col("__id").eqNullSafe(F.col("first_id")))
    on = F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    repeated = stored(rows.where("n > 1").select("__id", "__digest"), "page-repeats")
    marked = with_digest.join(later, on, "left").drop("__id", "__digest")
    if repeated.isEmpty():
        return marked.withColumn("repeat", F.lit(0))
    number = F.row_number().over(Window.partitionBy(id_column, "digest").orderBy("digest")) - 1
    several = marked.join(repeated, on, "left_semi").withColumn("repeat", number)
    return marked.join(repeated, on, "left_anti").withColumn("repeat", F.lit(0)).unionByName(several)


def _record_id(page_id: int | None, digest: str, repeat: int = 0) -> str:
    h = hashlib.md5(f"{page_id}|{digest}|{repeat}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + deflate.flush()


def _http(payload: bytes) -> bytes:
    parts = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for i in range(0, len(payload), CHUNK_BYTES):
        part = payload[i : i + CHUNK_BYTES]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _uri(url: str | None, page_id: int | None) -> str:
    clean = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    return clean or f"urn:page:{page_id}"


def _page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None, revisit: bool, repeat: int, segment_bytes: int) -> Iterator[bytes]:
    own = _record_id(page_id, digest, repeat)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if revisit:
        yield _record([*fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(first_id, digest))], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
        return
    block = _http(payload)
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    yield _record([*fields, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for number, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", _record_id(page_id, digest, -1000 * repeat - number)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number)]
        if at + segment_bytes >= len(block):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(more, block[at : at + segment_bytes])


def write_warc(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (page_id, url, payload, digest, first_id, revisit, repeat) rows as .warc.gz files of folder; returns (file, n_records).

    Each record is a gzip member of its own; a record's segments may lie in several files. Rows are sorted within a task, so
    names and bytes of files depend on the rows alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal parts, size, seq
            name = f"part-{part:07d}-{seq:06d}.warc.gz"
            write_file(f"{folder}/{name}", b"".join(parts))
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(parts)], pa.int64())], names=["file", "n_records"])
            parts, size, seq = [], 0, seq + 1
            return out

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "first_id", "revisit", "repeat")), strict=True):
                for record in _page_records(*(x.as_py() for x in row), segment_bytes):
                    parts.append(record)
                    size += len(record)
                    if size >= file_bytes:
                        yield close()
        if parts:
            yield close()

    dealt = pages.select("page_id", "url", "payload", "digest", "first_id", "revisit", F.col("repeat").cast("int")).sortWithinPartitions("page_id", "digest", "repeat", "url")
    return stored(dealt.mapInArrow(run, "file string, n_records long"), "warc-files")


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a .warc.gz file, which is fed to the inflater in small steps."""
    view, start = memoryview(content), 0
    while start < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof and start < len(view):
            step = view[start : start + READ_BYTES]
            parts.append(inflate.decompress(step))
            start += len(step) - len(inflate.unused_data)
        data, at = b"".join(parts), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(fields["content-length"])
            yield fields, data[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def read_records(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """One row for each record of the archives, by RECORD_SCHEMA; segment is null for whole records.

    With digests, whole records have the size and SHA-256 of their payload in place of the block, so that a table of them is slim.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(RECORD_KINDS.values())], names=list(RECORD_KINDS))

        def number(text: str | None) -> int | None:
            return None if text is None else int(text)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for f, block in parse_records(content.as_py()):
                    n = sha = None
                    if digests and "warc-segment-number" not in f:
                        payload, block = unchunk(block), None
                        n, sha = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((f["warc-record-id"], f["warc-type"], number(f.get("x-page-id")), f.get("warc-target-uri"), f.get("warc-segment-origin-id"), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, block, n, sha))
                    size += 500 + len(block or b"")
                    if size > 8_000_000:
                        yield as_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD_SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """Segmented records as one row each: continuations grouped by the origin's id, in order of segment number.

    complete says that segments 1 to n are all there, once each, and that their bytes add up to the total length that the last
    one gives; otherwise block is null. A group is the segments of one record, which are joined in one step.
    """
    own = ["record_type", "page_id", "uri", "refers_to", "digest"]
    grouped = records.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(F.array_sort(F.collect_list(F.struct("segment", "block", "total", *own))).alias("parts"))
    first = F.col("parts")[0]
    slim = grouped.select("record_id", *[first[c].alias(c) for c in own], F.col("parts.segment").alias("numbers"), F.element_at("parts", -1)["total"].alias("total"), F.col("parts.block").alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["record_id", *own]
        for batch in batches:
            whole = []
            for numbers, total, blocks in zip(*(batch.column(c) for c in ("numbers", "total", "blocks")), strict=True):
                joined = b"".join(b.as_py() for b in blocks)
                whole.append(joined if numbers.as_py() == list(range(1, len(numbers) + 1)) and len(joined) == total.as_py() else None)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array([w is not None for w in whole]), pa.array(whole, pa.binary())], names=[*kept, "complete", "block"])

    return slim.mapInArrow(run, "record_id string, record_type string, page_id long, uri string, refers_to string, digest string, complete boolean, block binary")


def unchunk(block: bytes) -> bytes:
    """The payload of an HTTP response: what follows its head, without chunk framing if the head says so."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk without its end")
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _payloads(records: DataFrame) -> DataFrame:
    names = [c for c in records.columns if c != "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = pa.array([None if b.as_py() is None else unchunk(b.as_py()) for b in batch.column("block")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), payload], names=[*names, "payload"])

    return records.mapInArrow(run, ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in names) + ", payload binary")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, record_type, page_id, uri, refers_to, digest, complete, payload) of the pages in the archives; revisits have an empty payload.

    The archives are read once, into a table from which whole records and segments are taken.
    """
    records = stored(read_records(spark, folder), "warc-records", compression="zstd")
    columns = ["record_id", "record_type", "page_id", "uri", "refers_to", "digest", "complete", "block"]
    single = records.where("segment is null").withColumn("complete", F.lit(True)).select(columns)
    return _payloads(single.union(reassemble(records.where("segment is not null")).select(columns)))


def page_digests(spark: SparkSession, folder: str) -> DataFrame:
    """read_pages with the size n and the SHA-256 sha of each payload in its place: whole records are digested where they are read, only segments are kept."""
    records = stored(read_records(spark, folder, digests=True), "warc-records", compression="zstd")
    columns = ["record_id", "record_type", "page_id", "refers_to", "digest", "complete"]
    single = records.where("segment is null").withColumn("complete", F.lit(True)).select(*columns, "n", "sha")
    segmented = _payloads(reassemble(records.where("segment is not null")))
    return single.union(segmented.select(*columns, F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's payload as archives give it back; a revisit's is its response's."""
    folder = scratch_dir(spark, "warc")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    marked = mark_revisits(pages)
    files = write_warc(marked.withColumn("revisit", F.col("first_id").isNotNull()), folder)
    if files.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    read = stored(page_digests(spark, folder), "warc-pages")
    response = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"), F.col("n").alias("first_n"), F.col("sha").alias("first_sha"))
    revisits = read.where("record_type = 'revisit'").join(response, "refers_to").where("first_sha = digest").select("page_id", F.col("first_n").alias("payload_bytes"), F.col("first_sha").alias("payload_digest"), "record_type", F.col("first").alias("refers_to"))
    own = read.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.union(revisits)


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
