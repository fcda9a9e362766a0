"""Media columns: signature sniffing, structure checks and carving.

Payloads live in a media container (8-bit mono PCM in RIFF/WAVE). What a blob
is follows from its bytes, not from its declared type: an Aho-Corasick machine
finds every magic sequence in one pass, and a validator per format confirms
structure and lengths.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.llm.common import arrow_map, table

#: Magic bytes of common media formats and their types.
MAGIC = (
    (b"RIFF", "riff"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"BM", "image/bmp"),
    (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x1f\x8b\x08", "application/gzip"),
    (b"fLaC", "audio/flac"),
    (b"OggS", "audio/ogg"),
    (b"ID3", "audio/mpeg"),
)
RATE = 8000


class Blob(bytes):
    """Bytes that remember where end marks stand, so that many headers before one mark don't each search for it."""

    def __init__(self, *_: object) -> None:
        self.marks: dict[bytes, list[int]] = {}
        self.zips: dict[int, int] | None = None

    def next(self, mark: bytes, at: int) -> int | None:
        """Where ``mark`` first stands from ``at`` on."""
        if mark not in self.marks:
            self.marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self)]
        known = self.marks[mark]
        k = bisect.bisect_left(known, at)
        return known[k] if k < len(known) else None

    def archives(self) -> dict[int, int]:
        """End of the zip file that begins at each place, by its end record."""
        if self.zips is None:
            self.zips = {}
            end = self.next(b"PK\x05\x06", 0)
            while end is not None and end + 22 <= len(self):
                size, offset, comment = struct.unpack_from("<IIH", self, end + 12)
                if end + 22 + comment <= len(self):
                    self.zips.setdefault(end - size - offset, end + 22 + comment)
                end = self.next(b"PK\x05\x06", end + 4)
        return self.zips


def store(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono WAVE file."""
    n = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)
    return head + payload + b"\0" * (n % 2)


def samples(blob: bytes) -> bytes:
    """The samples of a WAVE file, from its chunk list; ValueError if it is none."""
    found = _riff(blob, 0)
    if found is None or found[1] != "audio/wav":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= found[0]:
        kind, n = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if kind == b"data":
            return blob[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def _riff(b: bytes, at: int) -> tuple[int, str] | None:
    """End and type of a RIFF file whose chunks add up to its length."""
    if at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    kind = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}.get(b[at + 8 : at + 12])
    if kind is None or end > len(b):
        return None
    pos = at + 12
    while pos + 8 <= end:
        n = struct.unpack_from("<I", b, pos + 4)[0]
        pos += 8 + n + n % 2
    return (end, kind) if pos == end else None


def _png(b: bytes, at: int) -> tuple[int, str] | None:
    pos = at + 8
    while pos + 12 <= len(b):
        n = struct.unpack_from(">I", b, pos)[0]
        kind, end = b[pos + 4 : pos + 8], pos + 12 + n
        if end > len(b) or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end, "image/png"
        pos = end
    return None


def _jpeg(b: Blob, at: int) -> tuple[int, str] | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF and b[pos + 1] != 0xDA:
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
    if pos + 4 > len(b) or b[pos : pos + 2] != b"\xff\xda":
        return None
    end = b.next(b"\xff\xd9", pos)
    return (end + 2, "image/jpeg") if end else None


def _gif(b: bytes, at: int) -> tuple[int, str] | None:
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        tag = b[pos]
        if tag == 0x3B:
            return pos + 1, "image/gif"
        if tag == 0x21:
            pos += 2
        elif tag == 0x2C and pos + 10 <= len(b):
            pos += 11 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 0x80 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _bmp(b: bytes, at: int) -> tuple[int, str] | None:
    if at + 30 > len(b):
        return None
    size, _, offset, head = struct.unpack_from("<IIII", b, at + 2)
    ok = head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= offset <= size and at + size <= len(b)
    return (at + size, "image/bmp") if ok else None


def _pdf(b: Blob, at: int) -> tuple[int, str] | None:
    end = b.next(b"%%EOF", at)
    return (end + 5, "application/pdf") if end and b[at + 5 : at + 6].isdigit() else None


def _zip(b: Blob, at: int) -> tuple[int, str] | None:
    """A zip file from its first local header to the end record that points back at it."""
    end = b.archives().get(at)
    return (end, "application/zip") if end else None


def _gzip(b: bytes, at: int) -> tuple[int, str] | None:
    """A gzip member that inflates; its length and checksum are checked by zlib."""
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    z = zlib.decompressobj(31)
    pos = at
    try:
        while pos < len(b) and not z.eof:
            data = z.unconsumed_tail
            z.decompress(data or b[pos : pos + 65536], 1 << 20)
            pos += 0 if data else 65536
    except zlib.error:
        return None
    return (min(pos, len(b)) - len(z.unused_data), "application/gzip") if z.eof else None


def _crc_table(width: int, polynomial: int) -> list[int]:
    """Remainders of all bytes for a checksum of ``width`` bits, most significant bit first."""
    top, every, out = 1 << (width - 1), (1 << width) - 1, []
    for x in range(256):
        x <<= width - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial if x & top else x << 1) & every
        out.append(x)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_head(b: bytes, at: int) -> int | None:
    """The end of a FLAC frame's header whose checksum holds."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    pos, ones = at + 4, 0
    while b[pos] << ones & 0x80 and ones < 7:
        ones += 1
    size, rate = b[at + 2] >> 4, b[at + 2] & 15
    pos += max(1, ones) + {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in b[at:pos]:
        crc = _CRC8[crc ^ x]
    return pos + 1 if pos < len(b) and b[pos] == crc else None


def _flac(b: bytes, at: int) -> tuple[int, str] | None:
    """Metadata blocks, then frames: each ends where its checksum holds and, but for the last, where the next begins."""
    if at + 42 > len(b) or b[at + 4] & 0x7F or b[at + 5 : at + 8] != b"\0\0\x22":
        return None
    pos, last = at + 4, False
    while not last:
        if pos + 4 > len(b):
            return None
        last = bool(b[pos] & 0x80)
        pos += 4 + int.from_bytes(b[pos + 1 : pos + 4], "big")
    end = None
    while (body := _flac_head(b, pos)) is not None:
        crc, first, following = 0, None, None
        for k in range(pos, len(b)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[k]]
            if crc == 0 and k + 1 >= body + 2:
                first = first or k + 1
                if _flac_head(b, k + 1) is not None:
                    following = k + 1
                    break
        if first is None:
            return None
        end = pos = following or first
        if not following:
            break
    return (end, "audio/flac") if end else None


def _ogg(b: bytes, at: int) -> tuple[int, str] | None:
    pos, pages = at, 0
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0:
        n = b[pos + 26]
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
        pages += 1
    return (pos, "audio/ogg") if pages and pos <= len(b) else None


#: Kilobits a second of MPEG audio frames by (version 1, layer) and code 1 to 14, and samples a second of version 1.
KILOBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)


def _mpeg_frame(b: bytes, at: int) -> int | None:
    """The end of an MPEG audio frame, from its header."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3)
    rate, hertz, padding = b[at + 2] >> 4, b[at + 2] >> 2 & 3, b[at + 2] >> 1 & 1
    if version == 1 or layer == 4 or not 0 < rate < 15 or hertz == 3:
        return None
    bits = 1000 * KILOBITS[version == 3, layer][rate - 1]
    hz = HERTZ[hertz] >> {3: 0, 2: 1, 0: 2}[version]
    size = (12 * bits // hz + padding) * 4 if layer == 1 else (72 if layer == 3 and version != 3 else 144) * bits // hz + padding
    return at + size if at + size <= len(b) else None


def _id3(b: bytes, at: int) -> tuple[int, str] | None:
    """A tag and the run of whole frames after it."""
    if at + 10 > len(b) or b[at + 3] not in (2, 3, 4) or any(x & 0x80 for x in b[at + 6 : at + 10]):
        return None
    pos, end = at + 10 + functools.reduce(lambda a, x: a << 7 | x, b[at + 6 : at + 10], 0), None
    while (pos := _mpeg_frame(b, pos)) is not None:
        end = pos
    return (end, "audio/mpeg") if end else None


CHECKS: dict[str, Callable[[Blob, int], tuple[int, str] | None]] = {
    "riff": _riff,
    "image/png": _png,
    "image/jpeg": _jpeg,
    "image/gif": _gif,
    "image/bmp": _bmp,
    "application/pdf": _pdf,
    "application/zip": _zip,
    "application/gzip": _gzip,
    "audio/flac": _flac,
    "audio/ogg": _ogg,
    "audio/mpeg": _id3,
}


@functools.cache
def machine() -> ahocorasick.Automaton:
    """The machine over all magic bytes; bytes are read as Latin-1 characters."""
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def sniff(blob: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The blob's true type, and the media confirmed inside it as (start, end, type).

    The blob's own container starts at 0 and ends at its end; what follows its
    head and is confirmed by its validator counts as embedded. A signature
    that its validator rejects is chance and counts for nothing. Embedded
    items do not overlap: the first confirmed one wins.
    """
    outer, inside, taken, blob = "application/octet-stream", [], 0, Blob(blob)
    for last, (n, kind) in machine().iter(blob.decode("latin-1")):
        at = last - n + 1
        if at and at < taken:
            continue
        found = CHECKS[kind](blob, at)
        if found is None:
            continue
        if at == 0:
            outer = found[1]
        else:
            inside.append((at, found[0], found[1]))
            taken = found[0]
    return outer, inside


def _features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = []
    for t in batch.column(1).to_pylist():
        raw = (t or "").encode("utf-8")
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        blob = store(payload)
        kind, inside = sniff(blob)
        back = samples(blob)
        names = "+".join(f"{k}@{a}:{e}" for a, e, k in inside) or "none"
        rows.append(
            (
                len(raw),
                len(back),
                hashlib.sha256(back).hexdigest(),
                zlib.crc32(back[-64:]),
                len(blob),
                hashlib.sha256(blob).hexdigest(),
                f"declared={DECLARED};type={kind};corrected={kind != DECLARED};embedded={names}",
                len(inside),
            )
        )
    columns = zip(FEATURES, zip(*rows))
    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(v), pa.string() if t == "string" else pa.int64()) for (_, t), v in columns)], names=["id", *(n for n, _ in FEATURES)])


DECLARED = "application/octet-stream"
FEATURES = (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("n_embedded", "long"))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as audio samples, read it back, sniff and measure it.

    One output row per input row, in no shuffle. Null and empty texts are 64
    zero bytes; equal texts give equal values; other columns are not read; an
    empty table gives an empty result. A slice of texts is in memory at once.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return arrow_map(d, _features, f"id {dict(d.dtypes)['id']}, " + ", ".join(f"{n} {t}" for n, t in FEATURES))


def carve(blobs: DataFrame, id_col: str = "id", blob_col: str = "blob", declared_col: str | None = None) -> DataFrame:
    """One row per blob and embedded item: ``id, start, end, type, declared, corrected, bytes``.

    The blob itself has ``start`` 0 and its own bytes; ``corrected`` tells that
    its true type differs from the declared one. Null blobs give no row.
    """


    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k, (blob, declared) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if blob is None:
                continue
            kind, inside = sniff(blob)
            rows = [(0, len(blob), kind, declared, declared is not None and declared != kind, blob)]
            rows += [(a, e, x, None, False, blob[a:e]) for a, e, x in inside]
            values = [pa.array(list(v), t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()))]
            ids = batch.column(0).take(pa.array([k] * len(rows), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *values], names=["id", "start", "end", "type", "declared", "corrected", "bytes"])

    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    d = blobs.select(F.col(id_col).alias("id"), F.col(blob_col).alias("blob"), declared.alias("declared"))
    return arrow_map(d, run, f"id {dict(d.dtypes)['id']}, start long, end long, type string, declared string, corrected boolean, bytes binary")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form, lengths and digests of every document; null texts are empty, repeated rows stay."""
    return media_features(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
