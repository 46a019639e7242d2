"""WARC archives with a two-level capture index (operator 7).

Each task writes one archive of gzip members, one member a record, to the shared folder. Captures are sorted by
reversed-host URL key into index files of compressed blocks; the directory has one row for each block (its first key
and byte range). A lookup goes to the one index file whose range holds the key, binary-searches that file's part of
the directory, reads one or two blocks by range, and then the records by range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch

#: Captures in a block of the index, and duplicate digests that may be broadcast (28 bytes each).
BLOCK, DIGESTS = 2_000, 200_000
_CAPTURE = "key string, page_id long, file string, offset long, length long"
_BLOCKS = "first string, last string, file string, offset long, length long, captures long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, offset long"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: https://WWW.b.Example.com:443/x?y#z -> com,example,b)/x?y. Unreadable URLs are their own key."""
    url = (url or "").strip()
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return url
    if not host:
        return url
    host = host.removeprefix("www.")
    tail = f":{port}" if port and (u.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, response: int | None) -> bytes:
    """One WARC record; with response (the page_id it repeats) a revisit, which holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if response is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        *([] if response is None else [f"WARC-Refers-To: <urn:page:{response}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    kind = fields["WARC-Type"]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or "sha1:" + digest != fields["WARC-Payload-Digest"]):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": digest, "payload": payload}


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _inflate(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Write archives and their index below folder; the directory (one row a block) is returned and also in folder/directory.

    A payload is the body in UTF-8 (null: empty). Of pages with equal payloads of at least revisit_from bytes that
    with the largest id is the response and the others are revisits of it; shorter ones are all responses. Rows that
    share the largest id are all responses; a null id counts as the smallest. An empty table writes no file.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("body").cast("binary"))))
    sizes = rows.select("digest", "page_id", F.octet_length("body").alias("n")).where(F.col("n") >= revisit_from)
    scratch = Scratch(spark, "warc")
    again = scratch.write(sizes.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "digests")
    few = again.limit(DIGESTS + 1).count() <= DIGESTS
    rows = rows.join(F.broadcast(again) if few else again, "digest", "left").withColumn("response", F.when(F.col("page_id").eqNullSafe(F.col("response")), None).otherwise(F.col("response")))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        name, at, out = f"warc/{uuid.uuid4().hex}.warc.gz", 0, None  # a repeated task has a file of its own
        for batch in batches:
            for part in W.slices(batch, "body", 1 << 22):
                got: list[tuple] = []
                for r in part.to_pylist():
                    body = r["body"].encode()
                    data = _member(record(r["page_id"], r["url"], body, base64.b32encode(r["digest"]).decode(), len(body), r["response"]))
                    if out is None:
                        where.create_dir(f"{path}/warc", recursive=True)
                        out = where.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    got.append((url_key(r["url"]), r["page_id"], name, at, len(data)))
                    at += len(data)
                yield pa.record_batch(dict(zip(("key", "page_id", "file", "offset", "length"), map(list, zip(*got, strict=True)), strict=True)), schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    captures = scratch.write(rows.select("page_id", "url", "body", "digest", "response").mapInArrow(archive, _CAPTURE), "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        name, at, out = f"index/{uuid.uuid4().hex}.cdx.gz", 0, None
        held: list[dict] = []

        def flush() -> pa.RecordBatch:
            nonlocal at, out, held
            block, held = held[:BLOCK], held[BLOCK:]
            data = _member("".join(json.dumps(x) + "\n" for x in block).encode())
            if out is None:
                where.create_dir(f"{path}/index", recursive=True)
                out = where.open_output_stream(f"{path}/{name}", compression=None)
            out.write(data)
            at += len(data)
            return pa.RecordBatch.from_pylist([{"first": block[0]["key"], "last": block[-1]["key"], "file": name, "offset": at - len(data), "length": len(data), "captures": len(block)}])

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= BLOCK:
                yield flush()
        if held:
            yield flush()
        if out is not None:
            out.close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    placed.mapInArrow(index, _BLOCKS).write.parquet(f"{folder}/directory")
    scratch.drop(captures, again)
    return spark.read.schema(_BLOCKS).parquet(f"{folder}/directory")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """(key, page_id, file, offset, length) of every capture, from the blocks that the directory names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        for batch in batches:
            for b in batch.to_pylist():
                with where.open_input_file(f"{path}/{b['file']}") as f:
                    f.seek(b["offset"])
                    lines = _inflate(f.read(b["length"])).decode().splitlines()
                yield pa.RecordBatch.from_pylist([json.loads(x) for x in lines], pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/directory")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.select("file", "offset", "length").repartition(n, "file", "offset").mapInArrow(run, _CAPTURE)


def read_records(found: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of captures, by range reads in file order. A payload whose digest or length is wrong raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        name, f = None, None
        for batch in batches:
            got, size = [], 0
            for r in batch.to_pylist():
                if r["file"] != name:
                    if f is not None:
                        f.close()
                    name, f = r["file"], where.open_input_file(f"{path}/{r['file']}")
                f.seek(r["offset"])
                x = parse(_inflate(f.read(r["length"]))) | {"file": r["file"], "offset": r["offset"]}
                size += len(x["payload"])
                got.append(x if payloads else x | {"payload": None})
                if size > 1 << 23:
                    yield pa.RecordBatch.from_pylist(got, _schema)
                    got, size = [], 0
            yield pa.RecordBatch.from_pylist(got, _schema)
        if f is not None:
            f.close()

    _schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, _RECORD)


def lookup(urls: DataFrame, folder: str, url_col: str = "url") -> DataFrame:
    """(url, key, page_id, file, offset, length): the captures of each URL; URLs without any have no row, null URLs too.

    The top level is the first and last key of each index file, one row a file. A URL meets the files whose range
    holds its key; inside a file its part of the directory is binary-searched, and only blocks that can hold the key are read.
    """
    spark = urls.sparkSession
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/directory")
    files = sorted((tuple(r) for r in blocks.groupBy("file").agg(F.min("first"), F.max("last")).collect()), key=lambda r: r[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [f[1] for f in files]
        for batch in batches:
            out = []
            for u in batch.column(0).to_pylist():
                key = url_key(u)
                for name, _, last in reversed(files[: bisect.bisect_right(firsts, key)]):
                    if last < key:
                        break
                    out.append((u, key, name))
            yield pa.record_batch({c: pa.array([x[i] for x in out], pa.string()) for i, c in enumerate(("url", "key", "file"))})

    def search(key: tuple, t: pa.Table) -> pa.Table:
        where, path = _open(folder)
        rows = t.to_pylist()
        own = sorted((r["first"], r["last"], r["offset"], r["length"]) for r in rows if r["url"] is None)
        firsts, out, cache = [b[0] for b in own], [], (None, [])
        with where.open_input_file(f"{path}/{key[0].as_py()}") as f:
            for r in sorted((r for r in rows if r["url"] is not None), key=lambda r: r["key"]):
                at = bisect.bisect_right(firsts, r["key"]) - 1
                while at >= 0 and own[at][1] >= r["key"]:
                    if cache[0] != at:
                        f.seek(own[at][2])
                        cache = at, [json.loads(x) for x in _inflate(f.read(own[at][3])).decode().splitlines()]
                    keys = [c["key"] for c in cache[1]]
                    lo = bisect.bisect_left(keys, r["key"])
                    out += [{"url": r["url"], **c} for c in cache[1][lo : bisect.bisect_right(keys, r["key"])]]
                    at -= 1
        return pa.Table.from_pylist(out, pa.schema([("url", pa.string()), ("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    asked = urls.select(F.col(url_col).cast("string").alias("url")).where("url is not null").distinct().mapInArrow(place, "url string, key string, file string")
    entries = blocks.select("file", "first", "last", "offset", "length")
    both = asked.unionByName(entries.join(asked.select("file").distinct(), "file", "left_semi"), allowMissingColumns=True)
    return both.groupBy("file").applyInArrow(search, f"url string, {_CAPTURE}")
