"""Operator 9: WARC archives and the normaliser of monolithic gzip files.

``write_monolithic`` writes each partition's records, built with DataFrame
functions, as one WARC file that is a single gzip stream, as some crawlers
leave them. ``normalise`` inflates each such stream once from front to end,
writes every record as a gzip member of its own, and a sidecar index with each
member's offset, so one record can be read without the rest. ``read_records``
reads the normalised archives back by that index.

Of records with equal payloads that with the largest page_id is the response,
the others are revisits without a payload of their own. Null and empty pages
have the empty payload. Rows that repeat a page_id with an equal payload are
all responses. A null page_id is a revisit unless all its payload's ids are
null. Archives are files in the folder that driver and executors share; a task
that is run again writes files of its own, and only those that the finished
task names are read. Archives are streamed; one record must fit into memory. A
payload that many pages share is joined by broadcast, so its pages stay dealt
out. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.common import cut, fresh_path, join_classes

#: Bytes read at one time, compression level, and bytes of payload that a record must have to be a revisit.
READ, LEVEL, LEAST = 1 << 20, 6, 0
_CRLF = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: RFC 4648's base32 alphabet (fixed value).
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SEPARATOR = "\r\n\r\n"


def base32(hex_digest: Column) -> Column:
    """A digest of 40 hex digits as base32: each five hex digits are four characters."""
    parts = []
    for k in range(8):
        v = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, 1) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def record_kinds(pages: DataFrame, page_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, sha1, record_type and refers_to of each page."""
    rows = pages.select(F.col(f"`{page_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("payload", "utf-8")))
    # Digests alone are grouped; only payloads that occur more than once meet their pages again.
    copies = cut(rows.where(F.octet_length("payload") >= LEAST).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1"))
    known = join_classes(rows, copies, "sha1", "page_id", pages.count(), how="left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return known.select("page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))


def record_text() -> Column:
    """A WARC record without the two line ends behind it, from the columns of record_kinds()."""
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(F.lit(_HTTP), F.col("payload"))).otherwise(F.lit(_HTTP))
    head = [("WARC-Type: ", F.col("record_type")), ("WARC-Record-ID: ", name("page_id")), ("WARC-Date: ", F.lit("1970-01-01T00:00:00Z")), ("WARC-Target-URI: ", F.regexp_replace("url", r"[\r\n]+", " ")), ("WARC-Payload-Digest: sha1:", base32(F.col("sha1"))), ("X-Payload-Length: ", F.octet_length("payload").cast("string"))]
    lines = [F.lit("WARC/1.1" + _CRLF)] + [x for k, v in head for x in (F.lit(k), v, F.lit(_CRLF))]
    refers = F.when(response, F.lit("")).otherwise(F.concat(F.lit("WARC-Refers-To: "), name("refers_to"), F.lit(_CRLF), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + _CRLF)))
    return F.concat(*lines, refers, F.lit("Content-Type: application/http;msgtype=response" + _CRLF + "Content-Length: "), F.octet_length(block).cast("string"), F.lit(_SEPARATOR), block)


def write_monolithic(pages: DataFrame, path: str, **columns) -> None:
    """Writes a WARC file for each partition below path, each a single gzip stream. Line ends between records are the writer's line separator."""
    record_kinds(pages, **columns).select(record_text().alias("value")).write.option("lineSep", _SEPARATOR).option("compression", "gzip").text(path)


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if ":" not in uri.split("/")[0]:
        raise ValueError(f"{uri} doesn't name its file system")
    return fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and uri[5:7] != "//" else uri)


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields, header bytes and block of each record of an inflated stream."""
    buffer, mark = bytearray(), _SEPARATOR.encode()
    more = True

    def fill(size: int) -> bool:
        nonlocal more
        while more and len(buffer) < size:
            part = next(chunks, None)
            if part is None:
                more = False
            else:
                buffer.extend(part)
        return len(buffer) >= size

    while True:
        end = buffer.find(mark)
        while end < 0 and more:
            fill(len(buffer) + 1)
            end = buffer.find(mark)
        if end < 0:
            if bytes(buffer).strip():
                raise ValueError("a WARC stream ends within a header")
            return
        head = bytes(buffer[: end + 4])
        fields = dict(x.split(": ", 1) for x in head.decode().split(_CRLF)[1:] if ": " in x)
        size = int(fields["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("a WARC stream ends within a record")
        yield fields, head, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size + 4]


def _inflated(stream: io.IOBase) -> Iterator[bytes]:
    """The bytes of a gzip file, whatever its members, in bounded pieces; raises ValueError if it ends within a member."""
    d, whole = zlib.decompressobj(31), True
    while data := stream.read(READ):
        while data:
            yield d.decompress(data, 4 * READ)
            data, whole = d.unconsumed_tail, d.eof
            if d.eof:
                data, d = d.unused_data, zlib.decompressobj(31)
    while not whole and (rest := d.decompress(d.unconsumed_tail, 4 * READ)):
        yield rest
        whole = d.eof
    if not whole:
        raise ValueError("a gzip file ends within a member")


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrites each gzip file below source below target, a member for each record, with a sidecar index of JSON lines.

    Returns archive, index and n_records of each archive; nothing else in target counts.
    """
    files = spark.read.format("binaryFile").load(source).select("path")  # names only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                disk, folder = _filesystem(target)
                disk.create_dir(folder, recursive=True)
                name = f"{path.rsplit('/', 1)[1].split('.')[0]}-{uuid.uuid4().hex}.warc.gz"
                at, index = 0, []
                there, place = _filesystem(path)
                with there.open_input_stream(place, compression=None) as stream, disk.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    for fields, head, block in _records(_inflated(stream)):
                        c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = c.compress(head) + c.compress(block) + c.compress(_SEPARATOR.encode()) + c.flush()
                        out.write(member)
                        index.append(json.dumps({"id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "offset": at, "length": len(member)}))
                        at += len(member)
                with disk.open_output_stream(f"{folder}/{name}.idx", compression=None) as out:
                    out.write("\n".join(index).encode())
                yield pa.RecordBatch.from_pydict({"archive": [f"{target}/{name}"], "index": [f"{target}/{name}.idx"], "n_records": pa.array([len(index)], pa.int64())})

    return cut(files.mapInArrow(run, "archive string, index string, n_records long"))


def read_records(archives: DataFrame, emit_payload: bool = True) -> DataFrame:
    """Every record of the archives, read member by member at the indexed offsets.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and,
    with emit_payload, url and payload (null for revisits). Digests of payloads
    are computed anew and compared with the header's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, index in zip(b["archive"].to_pylist(), b["index"].to_pylist()):
                disk, where = _filesystem(archive)
                with disk.open_input_stream(_filesystem(index)[1], compression=None) as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines()]
                with disk.open_input_file(where) as f:
                    for k in range(0, len(entries), 256):
                        yield _read(f, entries[k : k + 256], emit_payload)

    spread = archives.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 2), "archive")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload string" * emit_payload)


def _page(name: str | None) -> int | None:
    number = name[len("<urn:x-page:") : -1] if name else "null"
    return None if number == "null" else int(number)


def _read(f: pa.NativeFile, entries: list[dict], emit_payload: bool) -> pa.RecordBatch:
    rows = []
    for e in entries:
        fields, _, block = next(_records(iter([zlib.decompress(f.read_at(e["length"], e["offset"]), 31)])))
        digest, size, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), None
        if fields["WARC-Type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its header says")
        more = (fields.get("WARC-Target-URI", ""), payload.decode() if payload is not None else None) if emit_payload else ()
        rows.append((_page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), *more))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[: 7 if emit_payload else 5])


def op9(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives, normalises them, and reads them back."""
    spark = pages.sparkSession
    source, target = fresh_path(spark, "warc-whole"), fresh_path(spark, "warc")
    write_monolithic(pages, source)
    return read_records(normalise(spark, source, target), emit_payload=False)
