"""WARC archives written from, and read back as, a table of record chunks.

A record's payload is cut into chunk rows (record id, chunk number, bytes), which JVM expressions make. A writer task
streams its chunks in order into one archive of gzip members, a member for each record; a reader task streams the
archive and gives chunk rows again, each with the SHA-256 of the payload so far, so that the last row of a record has
the digest of all of it. No task holds a whole archive, and the Python side holds one chunk of a record at a time.

Records with equal payloads of at least `least` bytes: those with the smallest id are responses, the others are revisits
without a payload. Null payload: empty. Every row has its own record: <urn:page:ID:DIGEST>, with ":1", ":2" and so on for
further rows of one id and payload; a null id is written "null". Rows with a null id are responses, unless a page with an
id has their payload. Archives go to the folder that the cluster shares, under a name that each attempt makes anew; the
manifest, a table written when all tasks are done, names those that count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, partitions, shared_dir, with_totals, written

CHUNK = 1 << 16
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _described(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, its size and digest, and key: what stands in a record's id."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    held = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    return held.withColumn("key", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "payload_digest"))


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """key and refers_to, one row for each pair of an id and a payload that are a revisit."""
    facts = _described(bounded(pages)).where(F.col("payload_bytes") >= least).select("page_id", "payload_digest", "key", F.monotonically_increasing_id().alias("row"))
    # a payload that a third of all pages share is spread over tasks by its rows, in sums and join alike
    held = with_totals(written(facts, "facts"), ["payload_digest"], F.col("row"), first=("min", F.col("page_id")), n=("sum", F.lit(1)))
    later = held.where((F.col("n") > 1) & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("first") < F.col("page_id"))))
    return later.groupBy("key").agg(F.min("first").alias("refers_to"))


def chunk_rows(pages: DataFrame, revisits: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, row (a number of the row), chunk_no, data and what the record's header needs, dealt out by key. Payloads are cut before
    they are moved, so that no exchange or join has a row larger than a chunk."""
    source = _described(pages).withColumn("row", F.monotonically_increasing_id())
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk).cast("int"))
    cut = source.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("data", F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk))).drop("payload")
    held = cut.repartition(partitions(pages.sparkSession), "key").join(revisits, "key", "left").where(F.col("refers_to").isNull() | (F.col("chunk_no") == 0))
    return held.select("key", "row", "chunk_no", "url", "payload_bytes", "payload_digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("data")).otherwise(F.lit(b"")).alias("data"))


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder; a path without scheme is local, and file: may have one or three slashes."""
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _header(row: dict, repeat: int) -> bytes:
    kind = "response" if row["refers_to"] is None else "revisit"
    url = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in row["url"])
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{row['key']}{f':{repeat}' if repeat else ''}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"WARC-Payload-Length: {row['payload_bytes']}", "Content-Type: text/html"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}:{row['payload_digest']}>"]
    return "\r\n".join([*lines, f"Content-Length: {row['payload_bytes'] if kind == 'response' else 0}", "", ""]).encode()


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes one archive for each partition of chunk rows that are dealt out by key; gives the manifest: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        path, out, records, member, last, repeat = f"{top}/{uuid.uuid4().hex}.warc.gz", None, 0, None, None, 0
        for batch in batches:
            for row in (r for k in range(0, batch.num_rows, 32) for r in batch.slice(k, 32).to_pylist()):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                if row["chunk_no"] == 0:
                    if member:
                        out.write(member.compress(END) + member.flush())
                    repeat = repeat + 1 if last is not None and last[0] == row["key"] else 0
                    member, records = zlib.compressobj(1, wbits=31), records + 1
                    out.write(member.compress(_header(row, repeat)))
                elif last != (row["key"], row["row"], row["chunk_no"] - 1):
                    raise ValueError(f"chunk {row['chunk_no']} of record {row['key']} follows {last}")
                out.write(member.compress(row["data"]))
                last = (row["key"], row["row"], row["chunk_no"])
        if out is not None:
            out.write(member.compress(END) + member.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([store.get_file_info(path).size], pa.int64())], ["path", "records", "bytes"])

    return chunks.sortWithinPartitions("key", "row", "chunk_no").mapInArrow(run, "path string, records long, bytes long")


def _members(stream: pa.NativeFile, chunk: int) -> Iterator[tuple[dict | None, bytes]]:
    """(headers, b"") where a record begins, then (None, bytes) of its content, at most about a chunk at once."""
    decoder, raw, head, left = zlib.decompressobj(31), b"", b"", -1
    while raw or (raw := stream.read(chunk)):
        data, raw = decoder.decompress(raw, chunk), decoder.unconsumed_tail
        if left < 0:
            head += data
            data = b""
            if END in head:
                head, data = head.split(END, 1)
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                left, head = int(fields["Content-Length"]), b""
                yield fields, b""
        if left > 0 and data:
            yield None, data[:left]
            left -= min(left, len(data))
        if decoder.eof:
            raw, decoder, left = decoder.unused_data, zlib.decompressobj(31), -1  # all that is left, the tail too


def read_chunks(manifest: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of all archives that the manifest names: page_id, chunk_no, record_type, refers_to, payload_digest (as the
    header has it), payload_bytes (as the header has it), data, and read_bytes, read_digest: of the content up to this row."""
    names = ["page_id", "chunk_no", "record_type", "refers_to", "payload_digest", "payload_bytes", "data", "read_bytes", "read_digest", "is_last"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def rows(path: str) -> Iterator[tuple]:
        store, _ = _store(folder)
        with store.open_input_stream(path, compression=None) as stream:
            now: list | None = None
            for fields, data in _members(stream, chunk):
                if fields is not None:
                    if now:
                        yield (*now, True)
                    digest, refers = hashlib.sha256(), fields.get("WARC-Refers-To")
                    number = lambda x: None if (own := x.split(":")[2]) == "null" else int(own)
                    now = [number(fields["WARC-Record-ID"]), 0, fields["WARC-Type"], number(refers) if refers else None, fields["WARC-Payload-Digest"].split(":")[1], int(fields["WARC-Payload-Length"]), b"", 0, digest.hexdigest()]
                else:
                    digest.update(data)
                    if now[7]:
                        yield (*now, False)
                        now[1] += 1
                    now[6:9] = [data, now[7] + len(data), digest.hexdigest()]
            if now:
                yield (*now, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row[6]) + 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    schema = "page_id long, chunk_no long, record_type string, refers_to long, payload_digest string, payload_bytes long, data binary, read_bytes long, read_digest string, is_last boolean"
    paths = manifest.select("path").repartition(partitions(manifest.sparkSession), "path")
    return paths.mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None, least: int = 100, chunk: int = CHUNK) -> tuple[DataFrame, str]:
    """Writes archives of all pages; gives the manifest (a written table) and the folder."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return written(write_archives(chunk_rows(pages, revisits(pages, least), chunk), folder), "warc-manifest"), folder


def records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record that the archives hold. A response's size and digest are those of what was read; a revisit
    has its header's, which the response that it refers to carries too."""
    own = read_chunks(manifest, folder).where("is_last")
    response = F.col("record_type") == "response"
    return own.select("page_id", F.when(response, F.col("read_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(response, F.col("read_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
