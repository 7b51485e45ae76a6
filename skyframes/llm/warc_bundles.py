"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of a bundle; a skippable frame at the bundle's end holds the
seek table (sizes of every frame), in the published seekable format; an index maps each record's id to its
bundle, frame, and offset inside that frame. Equal payloads of at least 100 bytes are stored once: the capture with
the smallest id is a ``response``, the others are ``revisit`` records that refer to it.

Defined results: null html is an empty payload; short payloads are all responses; rows that repeat both the
smallest id and its payload are all responses; a null id is never referred to (rows without an id revisit a row
with one; if no equal row has an id, all are responses); an empty table writes no bundle.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, make_dir, mark_members, materialize, open_store, scratch, table, write_file

MIN_REVISIT_BYTES = 100
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 * 1024, 64 * 1024 * 1024, 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, FOOTER_BYTES, ENTRY_BYTES = 0x184D2A5E, 0x8F92EAB1, 9, 8

INDEX_SCHEMA = "page_id long, bundle string, frame long, frame_start long, frame_bytes long, offset long, length long"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only."""
    revisit = refers_to is not None
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    target = "" if url is None else f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}\r\n"
    refer = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {record_uri(refers_to)}\r\n" if revisit else ""
    head = f"WARC/1.1\r\nWARC-Type: {'revisit' if revisit else 'response'}\r\nWARC-Record-ID: {record_uri(page_id)}\r\nWARC-Date: {date}\r\n{target}WARC-Payload-Digest: sha256:{digest}\r\n{refer}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def decode_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        start, size = end + 4, int(head["Content-Length"])
        yield at, head, data[start : start + size]
        at = start + size + 4


def page_of(uri: str) -> int | None:
    found = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "none" else int(found)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer frame for (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame, from the end of a seekable file object."""
    source.seek(size - FOOTER_BYTES)
    n, flags, magic = struct.unpack("<IBI", source.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    source.seek(size - FOOTER_BYTES - n * ENTRY_BYTES)
    sizes = list(struct.iter_unpack("<II", source.read(n * ENTRY_BYTES)))
    out, at = [], 0
    for packed, full in sizes:
        out.append((at, packed, full))
        at += packed
    return out


def read_record(uri: str, frame: int, offset: int, length: int) -> bytes:
    """One record by its place, reading the seek table and one frame."""
    import zstandard

    store, path = open_store(uri)
    with store.open_input_file(path) as source:
        start, packed, full = read_seek_table(source, source.size())[frame]
        source.seek(start)
        return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=full)[offset : offset + length]


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=LEVEL)
        index, held, held_bytes, frames, packed, packed_bytes = [], [], 0, [], [], 0

        def close_frame():
            nonlocal held, held_bytes, packed_bytes
            raw = b"".join(held)
            out = packer.compress(raw)
            first = len(index) - len(held)
            for i in range(first, len(index)):
                index[i][4] = len(out)
            frames.append((len(out), len(raw)))
            packed.append(out)
            packed_bytes += len(out)
            held, held_bytes = [], 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal index, frames, packed, packed_bytes, number
            if held:
                close_frame()
            write_file(uri(), iter([*packed, seek_table(frames)]))
            rows = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(zip(*index, strict=True))], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])
            index, frames, packed, packed_bytes, number = [], [], [], 0, number + 1
            return rows

        def uri() -> str:
            return f"{folder}/bundle-{part:06d}-{number:04d}.warc.zst"

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page, url, html, size, digest, refers = (c[i].as_py() for c in columns)
                record = encode_record(page, url, html or b"", size, digest, refers)
                index.append([page, uri(), len(frames), packed_bytes, 0, held_bytes, len(record)])
                held.append(record)
                held_bytes += len(record)
                if held_bytes >= frame_bytes:
                    close_frame()
                    if packed_bytes >= bundle_bytes:
                        yield close_bundle()
        if index:
            yield close_bundle()

    return run


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html bytes, size, digest, refers_to): html is null where a revisit stands for it.

    The smallest id of each repeated payload is found on digests alone (partial sums tame a hot payload). Only rows that may repeat
    one (by a bit table of fixed size) are joined to them; payloads that are short or alone aren't shuffled.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    first = rows.filter(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    first = materialize(first.withColumn("__h", F.xxhash64("digest")), "repeated")
    marked = mark_members(rows.withColumn("__h", F.xxhash64("digest")), "__h", first, "__h", "__may").drop("__h").withColumn("__may", F.col("__may") & (F.col("size") >= MIN_REVISIT_BYTES))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    alone = marked.filter("not __may").withColumn("refers_to", F.lit(None).cast("long"))
    rows = marked.filter("__may").join(first.drop("__h"), "digest", "left").withColumn("refers_to", refers).drop("first").unionByName(alone)
    return rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "digest", "refers_to")


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the archives; the result is the index (materialised, so the archives are written once)."""
    make_dir(folder)
    bounded_batches(pages.sparkSession)
    return materialize(plan_records(pages).mapInArrow(_write(folder, frame_bytes, bundle_bytes), INDEX_SCHEMA), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = open_store(uri)
            with store.open_input_file(path) as source:
                for start, packed, full in read_seek_table(source, source.size()):
                    source.seek(start)
                    rows = []
                    for _, head, block in decode_records(zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=full)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest, refers = head["WARC-Payload-Digest"].removeprefix("sha256:"), head.get("WARC-Refers-To")
                        if refers is None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"damaged record {head['WARC-Record-ID']} in {uri}")
                        rows.append((page_of(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], page_of(refers) if refers else None, head.get("WARC-Target-URI")))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, read from the archives; payload digests are verified."""
    names = index.select("bundle").distinct()
    return names.repartition(max(1, min(names.count(), index.sparkSession.sparkContext.defaultParallelism * 4))).mapInArrow(_read, READ_SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    read = read_bundles(write_bundles(table(spark, sf_dir, "pages"), folder))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < {MIN_REVISIT_BYTES} OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < {MIN_REVISIT_BYTES} OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM f
"""
