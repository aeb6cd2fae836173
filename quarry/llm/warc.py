"""WARC archives: writing, normalising whole-file gzip to one member a record with a sidecar index, and reading back."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import kept, partitions, shared_dir, tune

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """A response record, or a revisit record without the payload if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else ["WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)]),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of a gzip stream, of one member or several, in pieces."""
    stream = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            if stream.eof:
                stream = zlib.decompressobj(31)
            data = stream.decompress(chunk, CHUNK)
            if data:
                yield data
            while stream.unconsumed_tail and not stream.eof:
                data = stream.decompress(stream.unconsumed_tail, CHUNK)
                if data:
                    yield data
            chunk = stream.unused_data
    if not stream.eof:
        raise ValueError("the gzip stream is cut off")


def split_records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records of an archive's content; one record at a time is held."""
    held, pieces = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a header")
                return
        size = re.search(rb"(?im)^content-length:\s*(\d+)", bytes(held[:end]))
        if not held.startswith(b"WARC/") or not size:
            raise ValueError("not a WARC record")
        stop = end + 4 + int(size[1]) + 4
        while len(held) < stop:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(held[:stop])
        del held[:stop]


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload); names are lower-cased."""

    def fields(lines):
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http.decode().split("\r\n")[1:]), payload


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _chunks(stream) -> Iterator[bytes]:
    while data := stream.read(CHUNK):
        yield data


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", most_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per row as archives of one gzip stream each; gives the files as (path, records).

    A partition begins a new archive once its last one holds most_bytes before compression, which bounds what one
    task has to normalise later, but for a single longer record.

    Of rows with equal payloads, that of the largest key is a response and the others revisit it. Only the
    table of payloads that repeat is joined to the rows, so payloads are not shuffled where it is small. A task
    that runs again writes a new file, and only files of the list count.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("digest", F.sha1("body"))
    twice = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("key").alias("first")).where("n > 1").select("digest", "first")
    rows = rows.join(twice, "digest", "left").select("key", "url", "body", F.when(F.col("key").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers"))

    def run(batches):
        import pyarrow as pa

        context = TaskContext.get()
        done: list[tuple[str, int]] = []
        out = stream = path = None
        n = size = 0

        def close():
            out.write(stream.flush())
            out.close()
            done.append((path, n))

        for batch in batches:
            for k, u, b, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{folder}/part-{context.partitionId():05d}-{len(done):05d}-{context.taskAttemptId()}.warc.gz"
                    store, place = _store(path)
                    store.create_dir(place.rpartition("/")[0])
                    out, stream = store.open_output_stream(place, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    n = size = 0
                data = record(k, u, b, r)
                out.write(stream.compress(data))
                n, size = n + 1, size + len(data)
                if size >= most_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return kept(rows.mapInArrow(run, "path string, records long"), "archives")


def normalise_file(source: str, target: str, index: str, level: int = 6) -> int:
    """Inflate a stream once, write each record as a member of its own, and an index of (offset, length, id, type) lines."""
    store, place = _store(source)
    to, to_place = _store(target)
    at = n = 0
    with store.open_input_stream(place, compression=None) as data, to.open_output_stream(to_place, compression=None) as out, to.open_output_stream(_store(index)[1], compression=None) as lines:
        for whole in split_records(inflate(_chunks(data))):
            stream = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = stream.compress(whole) + stream.flush()
            out.write(member)
            warc = parse(whole)[0]
            lines.write(json.dumps({"offset": at, "length": len(member), "id": warc.get("warc-record-id"), "type": warc.get("warc-type")}).encode() + b"\n")
            at += len(member)
            n += 1
    return n


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(path, index, records) of the rewritten archives; each file is one task's, whatever its kind of gzip."""

    def run(batches):
        import pyarrow as pa

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rpartition("/")[2].removesuffix(".warc.gz")
                store, place = _store(folder)
                store.create_dir(place)
                target = f"{folder}/{name}-{attempt}.warc.gz"
                n = normalise_file(path, target, f"{target}.idx")
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([f"{target}.idx"]), pa.array([n])], names=["path", "index", "records"])

    spread = archives.select("path").repartition(partitions(archives.sparkSession), "path")
    return kept(spread.mapInArrow(run, "path string, index string, records long"), "members")


def read_records(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) by the sidecar indexes; a payload that does not fit its digest is an error."""

    def number(uri: str | None) -> int | None:
        text = (uri or "").strip("<>").rpartition(":")[2]
        return int(text) if text else None

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = _store(path)
                rows = []
                with store.open_input_file(place) as data, store.open_input_stream(_store(index)[1], compression=None) as lines:
                    for line in lines.read().splitlines():
                        entry = json.loads(line)
                        data.seek(entry["offset"])
                        warc, http, payload = parse(zlib.decompress(data.read(entry["length"]), 31))
                        digest = warc["warc-payload-digest"].partition(":")[2]
                        if warc["warc-type"] == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"{warc['warc-record-id']}: the payload does not fit its digest")
                        rows.append((number(warc["warc-record-id"]), int(http["content-length"]), digest, warc["warc-type"], number(warc.get("warc-refers-to")), warc.get("warc-target-uri")))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spread = archives.select("path", "index").repartition(partitions(archives.sparkSession), "path")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as whole-file gzip archives, normalise them and read the members back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A null html is an empty payload. Of equal payloads, empty ones included, all rows of the largest page_id are
    responses. A null page_id or url is kept. Very long payloads are held one at a time; an empty table gives no file.
    """
    folder = shared_dir(spark, "warc")
    archives = write_archives(pages, f"{folder}/streams")
    members = normalise_archives(archives, f"{folder}/members")
    store, place = _store(f"{folder}/streams")
    from pyarrow import fs

    if store.get_file_info(place).type != fs.FileType.NotFound:
        store.delete_dir(place)
    return read_records(members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BITS = "'0000000100100011010001010110011110001001101010111100110111101111'"
_BIT = " + ".join(f"{1 << (4 - i)} * CAST(substr(bits, CAST(5 * i + {i + 1} AS BIGINT), 1) AS BIGINT)" for i in range(5))
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(string_split(hex, ''), lambda c: substr({_BITS}, CAST(4 * (strpos('0123456789abcdef', c) - 1) + 1 AS BIGINT), 4)), '') AS bits FROM p),
d AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + {_BIT} AS BIGINT), 1)), '') AS payload_digest, max(page_id) OVER (PARTITION BY hex) AS leader FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM d
"""
