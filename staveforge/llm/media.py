"""Media columns in ISO base media files (operator 10).

Bytes are stored as 8-bit mono PCM in an ISO container with whole sample tables. Reading walks the nested boxes,
decodes the tables and gives codec, duration and the byte ranges of sync samples; it copies no payload unless asked.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Bytes in a sample, samples in a chunk, samples from one sync sample to the next, samples' clock.
SAMPLE, CHUNK, SYNC, RATE = 64, 64, 16, 8000
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of SAMPLE."""
    return raw + bytes(max(SAMPLE, -(-len(raw) // SAMPLE) * SAMPLE) - len(raw))


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes) -> bytes:
    """An ISO file that holds payload, whole SAMPLEs of unsigned 8-bit mono PCM."""
    n = len(payload) // SAMPLE
    chunks, ticks = -(-n // CHUNK), len(payload)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, CHUNK)] if chunks > 1 or n == CHUNK else []
    if n % CHUNK:
        runs.append((chunks, n % CHUNK))
    stsc = full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs))
    sync = range(1, n + 1, SYNC)
    wide = len(payload) > 1 << 31

    def moov(base: int) -> bytes:
        offsets = [base + i * CHUNK * SAMPLE for i in range(chunks)]
        stco = full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets))
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, SAMPLE)), stsc,
            full(b"stsz", struct.pack(">II", SAMPLE, n)), stco, full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1)
        mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    base = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(base) + box(b"mdat", payload)


def walk(data: memoryview, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte of content, end) of every box, outer ones first. A size of 0 reaches to the end; 1 means a 64-bit size."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} does not fit")
        here = (*path, kind)
        yield here, at + head, at + size
        if kind in _NESTED:
            yield from walk(data, at + head, at + size, here)
        at += size


def read_tables(data: bytes) -> dict:
    """codec, timescale, duration (ticks), byte offset and size of each sample, and the numbers (from 0) of sync samples, of the first track."""
    view = memoryview(data)
    own: dict[bytes, tuple[int, int]] = {}
    for path, a, b in walk(view):
        if path.count(b"trak") <= 1:
            own.setdefault(path[-1], (a, b))

    def ints(kind: bytes, skip: int, width: int = 1, form: str = ">u4") -> np.ndarray:
        a, _ = own[kind]
        n = struct.unpack_from(">I", view, a + skip)[0]
        return np.frombuffer(view, form, n * width, a + skip + 4).astype(np.int64).reshape(-1, width)

    a, _ = own[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", view, a + 20) if view[a] else struct.unpack_from(">II", view, a + 12)
    a, _ = own[b"stsd"]
    codec = bytes(view[a + 12 : a + 16]).decode("latin-1")
    a, _ = own[b"stsz"]
    fixed, n = struct.unpack_from(">II", view, a + 4)
    sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(view, ">u4", n, a + 12).astype(np.int64)
    offsets = (ints(b"co64", 4, 1, ">u8") if b"co64" in own else ints(b"stco", 4))[:, 0]
    runs = ints(b"stsc", 4, 3)
    upto = np.append(runs[1:, 0], len(offsets) + 1)
    per = np.repeat(runs[:, 1], upto - runs[:, 0])
    first = np.cumsum(per) - per  # number of each chunk's first sample
    before = np.cumsum(sizes) - sizes
    chunk = np.repeat(np.arange(len(offsets)), per)[:n]
    at = offsets[chunk] + before - before[first[chunk]]
    sync = ints(b"stss", 4)[:, 0] - 1 if b"stss" in own else np.arange(n)
    return {"codec": codec, "timescale": timescale, "duration": duration, "offset": at, "size": sizes, "sync": sync}


def read_payload(data: bytes, t: dict) -> bytes:
    """All samples in order."""
    if not len(t["size"]):
        return b""
    ends = t["offset"] + t["size"]
    cut = np.flatnonzero(t["offset"][1:] != ends[:-1]) + 1  # samples that follow each other are read at once
    lo, hi = np.append(0, cut), np.append(cut, len(ends)) - 1
    return b"".join(data[a:b] for a, b in zip(t["offset"][lo].tolist(), ends[hi].tolist(), strict=True))


_INFO = pa.struct([("codec", pa.string()), ("duration_ms", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))])
INFO = "struct<codec:string,duration_ms:bigint,n_samples:bigint,keyframes:array<struct<offset:bigint,length:bigint>>>"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text (null: empty) in UTF-8, padded, in an ISO file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 22):
                data, offsets = W.buffers(part.column(1))
                raw, cuts = data.tobytes(), offsets.tolist()
                texts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch({"id": part.column(0), "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array([mux(padded(x)) for x in texts], pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def describe(media: DataFrame, media_col: str = "media", out: str = "info") -> DataFrame:
    """media with a struct out (INFO) in place of an own column of that name; payloads are not read. Null media give null, damaged files raise an error."""
    kept = media.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(batch.schema.get_field_index(media_col)).to_pylist():
                if x is None:
                    rows.append(None)
                    continue
                t = read_tables(x)
                frames = [{"offset": a, "length": b} for a, b in zip(t["offset"][t["sync"]].tolist(), t["size"][t["sync"]].tolist(), strict=True)]
                rows.append({"codec": t["codec"], "duration_ms": t["duration"] * 1000 // max(1, t["timescale"]), "n_samples": len(t["size"]), "keyframes": frames})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _INFO)], [*batch.schema.names, out])

    from pyspark.sql import types as T

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.DataType.fromDDL(INFO))]))


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the op10 query, from what store() wrote: payload and features are read back out of the container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = x.as_py()
                t = read_tables(x)
                p = read_payload(x, t)
                s = np.frombuffer(p, np.uint8)
                level = int(s[:n].sum(dtype=np.int64))
                turns = int(np.count_nonzero((s[1:] ^ s[:-1]) & 0x80))
                key = t["sync"]
                feature = f"{t['codec'].strip()}|{t['duration'] * 1000 // t['timescale']}ms|{len(t['size'])}s|{len(key)}k|{int(t['offset'][key[0]])}-{int(t['offset'][key[-1]] + t['size'][key[-1]])}|{level}|{turns}"
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(x), hashlib.sha256(x).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.select(F.col(id_col).cast("long").alias("id"), "n_bytes", "media")
    return rows.mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
