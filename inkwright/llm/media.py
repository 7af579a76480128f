"""Media columns by signature sniffing: magic bytes, validators, corrected types and carved media.

An Aho-Corasick automaton finds every magic string in one pass over the bytes. A hit is only a hint:
the validator of its format checks structure and lengths and says how long the object is.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Carved bytes that are handed on together.
CARVED_BYTES = 8 << 20


class Found(NamedTuple):
    """A confirmed object: media type, first byte, length, and where its samples lie (from its first byte)."""

    media_type: str
    offset: int
    length: int
    payload: tuple[int, int]


def _wav(b: bytes, at: int, _: Marks) -> Found | None:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    length = 8 + struct.unpack_from("<I", b, at + 4)[0]
    if at + length > len(b):
        return None
    p, payload, form = at + 12, None, False
    while p + 8 <= at + length:
        size = struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + size > at + length:
            return None
        form |= b[p : p + 4] == b"fmt " and size >= 16
        if b[p : p + 4] == b"data":
            payload = (p + 8 - at, size)
        p += 8 + size + size % 2
    return Found("audio/wav", at, length, payload) if form and payload else None


def _png(b: bytes, at: int, _: Marks) -> Found | None:
    p, first, payload = at + 8, True, (0, 0)
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or first != (kind == b"IHDR" and size == 13) or zlib.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IDAT" and not payload[1]:
            payload = (p + 8 - at, size)
        if kind == b"IEND":
            return Found("image/png", at, end - at, payload)
        first, p = False, end
    return None


def _gif(b: bytes, at: int, _: Marks) -> Found | None:
    if len(b) < at + 13:
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    start, images = p - at, 0
    while p < len(b):
        if b[p] == 0x3B:
            return Found("image/gif", at, p + 1 - at, (start, p - at - start)) if images else None
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 < len(b):
            p += 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1
            images += 1
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: bytes, at: int, _: Marks) -> Found | None:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, size = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if size < 2 or kind in (0x00, 0xFF):
            return None
        frame |= kind in (0xC0, 0xC1, 0xC2)
        p += 2 + size
        if kind == 0xDA:
            end = p
            while (end := b.find(b"\xff", end)) >= 0 and end + 1 < len(b) and (b[end + 1] == 0 or 0xD0 <= b[end + 1] <= 0xD7):
                end += 2
            if frame and end >= 0 and b[end + 1 : end + 2] == b"\xd9":
                return Found("image/jpeg", at, end + 2 - at, (p - at, end - p))
            return None
    return None


class Marks:
    """Where a content holds its end marks: each kind is searched once, however many magic bytes ask."""

    def __init__(self, content: bytes):
        self.content = content
        self.known: dict[bytes, list[int]] = {}

    def places(self, mark: bytes) -> list[int]:
        if mark not in self.known:
            self.known[mark] = [m.start() for m in re.finditer(re.escape(mark), self.content)]
        return self.known[mark]

    def after(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` at or after ``at``, or -1."""
        places = self.places(mark)
        i = bisect.bisect_left(places, at)
        return places[i] if i < len(places) else -1


def _pdf(b: bytes, at: int, marks: Marks) -> Found | None:
    end = marks.after(b"%%EOF", at)
    if end < 0 or not b[at + 5 : at + 6].isdigit():
        return None
    start = marks.after(b"startxref", at)
    if start < 0 or start + 9 > end:
        return None
    return Found("application/pdf", at, end + 5 - at, (0, end + 5 - at))


def _zip(b: bytes, at: int, marks: Marks) -> Found | None:
    end = marks.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    if end - at != size + start or end + 22 + note > len(b) or b[at + start : at + start + 4] not in (b"PK\x01\x02", b"PK\x05\x06"):
        return None
    return Found("application/zip", at, end + 22 + note - at, (0, start))


#: The magic bytes of each format.
SIGNATURES: dict[bytes, Callable[[bytes, int, Marks], Found | None]] = {
    b"RIFF": _wav,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"%PDF-": _pdf,
    b"PK\x03\x04": _zip,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in SIGNATURES:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(content: bytes, search: ahocorasick.Automaton) -> list[Found]:
    """All confirmed objects, outermost first; what lies within a confirmed object is found as well."""
    out, marks = [], Marks(content)
    for end, magic in search.iter(content.decode("latin-1")):
        if found := SIGNATURES[magic](content, end + 1 - len(magic), marks):
            out.append(found)
    return sorted(out, key=lambda x: (x.offset, -x.length))


def wav_of(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as one channel of unsigned 8-bit samples in a RIFF/WAVE container."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def padded(raw: bytes, unit: int = 64) -> bytes:
    """Zero bytes up to the next positive multiple of ``unit``."""
    return raw + b"\0" * ((-len(raw)) % unit or (0 if raw else unit))


def sniff_media(rows: DataFrame, *, content: str, declared: str) -> DataFrame:
    """``rows`` with ``media_type`` (corrected), ``corrected`` and ``media``: the carved objects.

    ``media`` is an array of (media_type, offset, length, payload_offset, payload_length, content).
    The type is that of a confirmed object at byte 0, else a declared type that no signature speaks
    against, else ``application/octet-stream``: a declared type with a known signature that the bytes
    don't bear out is dropped. Null content holds nothing and keeps its declared type, empty content
    holds nothing; each row, repeated or not, is sniffed by itself; an empty table gives no rows.
    Columns of these three names are replaced, all others may have any name.
    """
    kept = [c for c in rows.columns if c not in ("media_type", "corrected", "media")]
    known = ("audio/wav", "image/png", "image/gif", "image/jpeg", "application/pdf", "application/zip")
    schema = rows.select(*kept).schema.add("media_type", "string").add("corrected", "boolean").add("media", _item_type())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for batch in batches:
            contents, declarations, done, size = batch.column(content), batch.column(declared), 0, 0
            kinds, media = [], []
            for i in range(batch.num_rows):
                raw, said = contents[i].as_py(), declarations[i].as_py()
                found = sniff(bytes(raw), search) if raw is not None else []
                kind = found[0].media_type if found and found[0].offset == 0 else said
                if raw is not None and kind == said and said in known and not (found and found[0].offset == 0):
                    kind = "application/octet-stream"
                kinds.append((kind, kind != said))
                media.append([{"media_type": f.media_type, "offset": f.offset, "length": f.length, "payload_offset": f.payload[0], "payload_length": f.payload[1], "content": raw[f.offset : f.offset + f.length]} for f in found])
                size += sum(f.length for f in found)
                if size > CARVED_BYTES or i + 1 == batch.num_rows:
                    columns = [pa.array([k for k, _ in kinds], pa.string()), pa.array([c for _, c in kinds], pa.bool_()), pa.array(media, _ARROW_ITEM)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(done, len(kinds)).columns, *columns], names=[*kept, "media_type", "corrected", "media"])
                    done, size, kinds, media = i + 1, 0, [], []

    return rows.select(*kept).mapInArrow(run, schema)


_ARROW_ITEM = pa.list_(pa.struct([("media_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_offset", pa.int64()), ("payload_length", pa.int64()), ("content", pa.binary())]))


def _item_type():
    from pyspark.sql import types as T

    fields = [("media_type", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("payload_offset", T.LongType()), ("payload_length", T.LongType()), ("content", T.BinaryType())]
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


def text_media(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as sound, found again by its signature, read back and described.

    The UTF-8 bytes, padded to 64, become the samples of a WAV object whose declared type is
    ``application/octet-stream``; sniffing must correct it, confirm its lengths and carve the samples.
    Returns ``key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature``; the feature names the corrected type, the number of objects found (a text that itself
    holds a valid object shows more than one) and mean, least and greatest sample. Null texts count
    as empty; keys may be null; repeated rows are stored and read each; an empty table gives no rows.
    Other columns are not read. Time grows in proportion to a text's length.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def describe(raw: bytes, search: ahocorasick.Automaton) -> tuple:
        stored = wav_of(padded(raw))
        found = sniff(stored, search)
        outer = found[0]
        at, size = outer.payload
        back = stored[outer.offset + at : outer.offset + at + size]
        samples = np.frombuffer(back, dtype=np.uint8)
        feature = f"{outer.media_type};objects={len(found)};mean={int(samples.sum(dtype=np.int64)) * 1000 // size};min={samples.min()};max={samples.max()}"
        return len(raw), size, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                made = [describe((x.as_py() or "").encode(), search) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(x)) for x in zip(*made, strict=True))], names=names)

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)
