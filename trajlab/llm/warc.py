"""WARC archives: whole-file gzip streams normalised to one member a record, with an offset index.

`write_streams` writes pages as archives that are one gzip stream each, as some
crawlers leave them. `normalise` inflates such a stream once, front to back,
writes every record as a gzip member of its own and a sidecar index of
offsets; on the way it turns repeated payloads into revisit records.
`read_records` seeks to each record by the index.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlab.llm.files import located, removed, written
from trajlab.llm.tables import checkpointed, fresh_dir, table

#: records' bytes in one archive
FILE_BYTES = 32 << 20
READ_BYTES = 1 << 20
LEVEL = 3
#: payloads under this many bytes never become revisits
MIN_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(kind: str, page_id: int | None, url: str | None, http: bytes, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record. A null URL is an empty one; control characters and spaces in it are
    percent-encoded. The page's own number travels in the extension field Page-Id, absent if null."""
    block = http + payload
    uri = "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url or "")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if page_id is not None:
        head.append(("Page-Id", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
        if refers_to is not None:
            head.append(("Page-Refers-To", str(refers_to)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def http_head(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]) if k}


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file in pieces, be it one member or many. A cut file is an error."""
    inflate, begun = zlib.decompressobj(31), False
    while piece := stream.read(READ_BYTES):
        while piece:
            begun = True
            yield inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof:
                inflate, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, holding one record and one piece at a time."""
    held = bytearray()

    def upto(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not upto(len(held) + 1):
                if held.strip():
                    raise ValueError("the archive ends within a record's header")
                return
        head = fields(bytes(held[:end]))
        n = int(head["content-length"])
        if not upto(end + 4 + n + 4):
            raise ValueError("the archive ends within a record")
        yield head, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n + 4]


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    rows = ((i, u, h) for b in batches for i, u, h in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True))
    row = next(rows, None)
    while row is not None:
        done = []
        with written(folder, "stream", ".warc.gz") as (out, uri):
            deflate, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
            while row is not None and size < file_bytes:
                page_id, url, html = row
                payload = (html or "").encode()
                digest = payload_digest(payload)
                raw = record("response", page_id, url, http_head(len(payload)), payload, digest)
                out.write(deflate.compress(raw))
                done.append((page_id, len(done), len(payload), digest))
                size += len(raw)
                row = next(rows, None)
            out.write(deflate.flush())
        ids, seqs, sizes, digests = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([uri] * len(done)), pa.array(seqs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests)], ["page_id", "file", "seq", "payload_bytes", "payload_digest"])


def write_streams(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of single gzip streams, and a row for each record: page_id, file, seq, payload_bytes,
    payload_digest. Each scan partition writes its own files; the rows are kept in the shared folder,
    so the files are written once. A null html is an empty payload; repeated rows are repeated records."""
    return checkpointed(pages.select("page_id", "url", "html").mapInArrow(lambda it: _write(it, folder, file_bytes), "page_id long, file string, seq long, payload_bytes long, payload_digest string"))


def revisits(written_records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(file, seq, refers_to) of the records that repeat a payload of at least min_bytes bytes: all of
    its records but the one with the largest page_id. A page_id that repeats with the same payload has
    one response too; a null page_id comes below all others."""
    key = ["payload_digest", "payload_bytes"]
    sized = written_records.where(F.col("payload_bytes") >= min_bytes)
    best = sized.groupBy(*key).agg(F.max(F.struct("page_id", "file", "seq")).alias("best"), F.count("*").alias("n")).where("n > 1")
    # a table of its own, so that the records of a frequent payload are dealt to several tasks where they meet it
    best = checkpointed(best)
    return sized.join(best, key).where((F.col("file") != F.col("best.file")) | (F.col("seq") != F.col("best.seq"))).select("file", "seq", F.col("best.page_id").alias("refers_to"))


def _normalise(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, again in zip(batch.column("file").to_pylist(), batch.column("again").to_pylist(), strict=True):
            repeats = {x["seq"]: x["refers_to"] for x in again}
            system, path = located(source)
            index, offset = [], 0
            with system.open_input_stream(path, compression=None) as stream, written(folder, "records", ".warc.gz") as (out, uri):
                for seq, (head, block) in enumerate(records(inflated(stream))):
                    page_id = int(head["page-id"]) if "page-id" in head else None
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = "revisit" if seq in repeats else head["warc-type"]
                    raw = record(kind, page_id, head["warc-target-uri"], http + b"\r\n\r\n", b"" if seq in repeats else payload, head["warc-payload-digest"].removeprefix("sha1:"), repeats.get(seq))
                    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = deflate.compress(raw) + deflate.flush()
                    out.write(member)
                    index.append({"offset": offset, "length": len(member), "type": kind, "page_id": page_id})
                    offset += len(member)
            with written(folder, "index", ".jsonl") as (out, index_uri):
                out.write("".join(json.dumps(x) + "\n" for x in index).encode())
            yield pa.RecordBatch.from_pylist([{"warc": uri, "index": index_uri, "n_records": len(index)}], schema=pa.schema([("warc", pa.string()), ("index", pa.string()), ("n_records", pa.int64())]))


def normalise(written_records: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(warc, index, n_records) of each archive rewritten with a gzip member a record. A task holds the
    revisit numbers of one archive at a time, which FILE_BYTES bounds, and no page moves between tasks."""
    again = revisits(written_records, min_bytes).groupBy("file").agg(F.collect_list(F.struct("seq", "refers_to")).alias("again"))
    files = written_records.select("file").distinct().join(again, "file", "left").withColumn("again", F.coalesce("again", F.expr("cast(array() as array<struct<seq:bigint,refers_to:bigint>>)")))
    # dealt in turn, as a partitioning by file would be merged into the join's few, small partitions
    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return checkpointed(spread.mapInArrow(lambda it: _normalise(it, folder), "warc string, index string, n_records long"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for warc, index in zip(batch.column("warc").to_pylist(), batch.column("index").to_pylist(), strict=True):
            system, path = located(index)
            with system.open_input_stream(path) as stream:
                entries = [json.loads(x) for x in stream.read().decode().splitlines()]
            system, path = located(warc)
            rows = []
            with system.open_input_file(path) as archive:
                for entry in entries:
                    archive.seek(entry["offset"])
                    (head, block), = records(iter([zlib.decompress(archive.read(entry["length"]), 31)]))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{warc} at {entry['offset']}: the payload doesn't have its digest")
                    whole = int(fields(http)["content-length"])
                    rows.append((int(head["page-id"]) if "page-id" in head else None, whole, digest, head["warc-type"], int(head["page-refers-to"]) if "page-refers-to" in head else None))
            for a in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[a : a + 10_000], strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of the archives by its index entry: page_id, payload_bytes and payload_digest of
    the full payload, record_type, refers_to. Responses are held against their digest."""
    spread = archives.select("warc", "index").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "warc")
    return spread.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as normalised archives under folder, by default a new one in the shared folder;
    returns their (warc, index, n_records). An empty table gives no archive. The single-stream files
    in between go once the normalised ones stand."""
    spark = pages.sparkSession
    streams = fresh_dir(spark, "streams")
    done = normalise(write_streams(pages, streams, file_bytes), folder or fresh_dir(spark, "archives"), min_bytes)
    removed(spark, streams)
    return done


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through the archives and back; they go once they are read."""
    folder = fresh_dir(spark, "archives")
    try:
        return checkpointed(read_records(archive(table(spark, sf_dir, "pages"), folder)))
    finally:
        removed(spark, folder)


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(8), lambda i: list_reduce(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1)::BIGINT, 1)), lambda a, b: a || b)), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS best FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < best THEN best END AS refers_to FROM m
"""
