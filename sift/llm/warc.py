"""WARC: archives with one gzip member per record, and a sequential reader.

Writing: each task writes its rows to one archive ``part-NNNNN.warc.gz`` in a
folder shared by all machines, under a temporary name that is renamed when it
is complete, so a repeated task replaces its own file. A payload of at least
``min_revisit`` bytes is stored once, in the record with the largest id; the
other rows become revisit records that name it. Reading: one task per archive
inflates members in small steps, frames each block by its Content-Length and
verifies block and payload digests; a record at a time is in memory.

Defined results: a null or empty text is an empty payload; a null id or url is
left out of the record and read back as null; repeated rows each give a record
(those with the id of the response are responses too; null ids neither revisit nor
are revisited). An empty table gives archives without records. Extra columns
are ignored. Equality of payloads is that of their SHA-256 (SHA-1 only labels
the payload). A payload that a third of all rows share is handled by partial
aggregation and a join that adaptive execution splits.

The folder must be a URI that ``pyarrow.fs`` opens (file, hdfs, s3, gs); by
default it is a new one under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.llm.common import scratch_path

STEP = 1 << 18
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that is cut off, badly framed or fails a digest."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode_record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One gzip member with one record."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", DATE),
            ("WARC-Record-ID", _urn(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, _sha1(block))}>"),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _sha1(payload)),
            ("WARC-Block-Digest", _sha1(block)), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~")))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def read_records(stream):
    """Yield (headers, block) of each member of a binary stream, in order."""
    left = b""
    while True:
        left = left or stream.read(STEP)
        if not left:
            return
        z, data, end, length, head = zlib.decompressobj(31), bytearray(), -1, None, {}
        while not z.eof:
            if not left:
                left = stream.read(STEP)
                if not left:
                    raise WarcError("the archive ends inside a member")
            data += z.decompress(left, STEP)
            left = z.unused_data if z.eof else z.unconsumed_tail
            if end < 0 and (end := data.find(b"\r\n\r\n")) >= 0:
                first, *lines = data[:end].decode().split("\r\n")
                if not first.startswith("WARC/1."):
                    raise WarcError(f"not a record: {first[:40]!r}")
                head = dict(x.split(": ", 1) for x in lines)
                length = int(head["Content-Length"])
            if length is not None and len(data) > end + 8 + length:
                raise WarcError("a member holds more than its record")
        if length is None or len(data) != end + 8 + length or not data.endswith(b"\r\n\r\n"):
            raise WarcError("Content-Length does not frame the block")
        block = bytes(data[end + 4:end + 4 + length])
        if head.get("WARC-Block-Digest", _sha1(block)) != _sha1(block):
            raise WarcError(f"block digest differs: {head.get('WARC-Record-ID')}")
        yield head, block


def decode_record(head: dict, block: bytes) -> dict:
    """Fields of a record; the payload's digest is verified where it is held."""
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"]
    payload = None
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if _sha1(payload) != digest or len(payload) != int(head["X-Payload-Length"]):
            raise WarcError(f"payload digest differs: {head.get('WARC-Record-ID')}")
    number = lambda k: int(head[k]) if k in head else None
    uri = head.get("WARC-Target-URI")
    return {"page_id": number("X-Page-ID"), "url": None if uri is None else unquote(uri), "record_type": kind,
            "payload_bytes": int(head["X-Payload-Length"]), "refers_to": number("X-Refers-To-Page-ID"),
            "payload_digest": base64.b32decode(digest[5:]).hex(), "payload": payload}


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_revisit: int = 1000) -> DataFrame:
    """Write every row to an archive; returns ``path, records, bytes`` per file."""
    spark = pages.sparkSession
    folder = (folder or scratch_path(spark, "warc")).rstrip("/")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.when((F.octet_length("payload") >= min_revisit) & F.col("page_id").isNotNull(),
                                         F.sha2("payload", 256)))
    held = (rows.filter(F.col("key").isNotNull()).groupBy("key")
            .agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    todo = rows.join(held, "key", "left").select(
        "page_id", "url", "payload", F.when(F.col("kept") != F.col("page_id"), F.col("kept")).alias("refers_to"))

    def write(batches):
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.warc.gz"
        partial = f"{at}/.{name}.{task.taskAttemptId()}"
        n = size = 0
        with fs.open_output_stream(partial, compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, payload, refers = (batch.column(c)[i].as_py() for c in range(4))
                    member = encode_record(page_id, url, payload, refers)
                    out.write(member)
                    n, size = n + 1, size + len(member)
        fs.move(partial, f"{at}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    listing = f"{folder}/_listing"
    todo.mapInArrow(write, "path string, records long, bytes long").write.parquet(listing)
    return spark.read.schema("path string, records long, bytes long").parquet(listing)


READ_SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, refers_to long, "
               "payload_digest string, payload binary")


def read_archives(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read every record of the archives named in ``path``; one task an archive
    (the rows that name archives are dealt out one by one)."""
    n = max(1, files.count())

    def parse(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    rows, held = [], 0
                    for head, block in read_records(stream):
                        r = decode_record(head, block)
                        held += len(block)
                        if not with_payload:
                            r["payload"] = None
                        rows.append(r)
                        if len(rows) >= 1000 or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema=OUT)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=OUT)

    return files.select("path").repartitionByRange(n, "path").mapInArrow(parse, READ_SCHEMA)


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                 ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
                 ("payload", pa.binary())])
