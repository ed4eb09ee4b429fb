"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every magic number in a blob in one pass. Each hit is then checked by a validator of its
format, which walks the structure (chunks, frames, lengths, checksums) and gives the object's true length or refuses it. What
passes corrects a wrong declared type and is carved out with offset and length. Hits inside an accepted object are checked as well,
with the object's end as their bound, so media in containers, in chunks of sound files, or as thumbnails are carved too; every item names
the item that holds it.

Lengths: a FLAC ends with the frame that completes its samples (frames end where their checksum does), an MP4 with its last box (64-bit
sizes and boxes that reach to the end included), a PDF with the last of its updates, a ZIP with the comment of its directory. ZIP64 and
encrypted files are not read.

Cases: a null blob is an empty one; an empty or unknown blob keeps no items and gets the type application/octet-stream; a
truncated object is refused; very long blobs are read whole, each hit is validated once; of two formats at one place the first in
alphabetical order counts; equal blobs give equal rows; repeated rows are kept; an empty table gives an empty result; only the named
columns are read, so further columns of any name do no harm (`sniff_media` drops them).
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import cache
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burncal.llm.common import id_and_text, map_batches, small_batches

#: Magic number -> (format, its offset from the start of the object).
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"BM": ("image/bmp", 0),
    b"RIFF": ("riff", 0),
    b"%PDF-": ("application/pdf", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
    b"OggS": ("audio/ogg", 0),
    b"fLaC": ("audio/flac", 0),
    b"ftyp": ("video/mp4", 4),
    b"PK\x03\x04": ("application/zip", 0),
}
#: Marks of ends, found in the same pass.
PDF_END, ZIP_END = b"%%EOF", b"PK\x05\x06"
#: Boxes at the top of an MP4 file.
MP4_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"uuid", b"wide", b"meta", b"styp", b"sidx", b"ssix", b"mfra", b"pdin", b"udta", b"emsg", b"prft"}
#: RIFF form -> type.
RIFF_FORMS = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}
UNKNOWN = "application/octet-stream"
ROW = 192  # samples in an image row; payloads are padded to whole rows
RATE = 8000


class Item(NamedTuple):
    """A carved object; `inside` is the position of the item that holds it, -1 for none."""

    type: str
    offset: int
    length: int
    inside: int


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, (kind, offset) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + offset))
    for mark in (PDF_END, ZIP_END):
        found.add_word(mark.decode("latin-1"), (mark, len(mark) - 1))
    found.make_automaton()
    return found


class Signs:
    """All magic numbers of a blob, as (place, format), and what ends PDF and ZIP files."""

    def __init__(self, blob: bytes):
        self.blob, self.hits, self.pdf_ends, self.pdf_starts, self.zip_ends = blob, [], [], [], {}
        for end, (kind, back) in _automaton().iter(blob.decode("latin-1")):
            at = end - back
            if kind == PDF_END:
                self.pdf_ends.append(at)
            elif kind == ZIP_END:
                self._zip_end(at)
            elif at >= 0:
                self.hits.append((at, kind))
                if kind == "application/pdf":
                    self.pdf_starts.append(at)
        self.hits.sort()

    def _zip_end(self, at: int) -> None:
        """A directory's end tells where its file starts."""
        if at + 22 <= len(self.blob):
            disk, first_disk, here, total, size, offset, comment = struct.unpack_from("<HHHHIIH", self.blob, at + 4)
            start = at - size - offset
            if not disk and not first_disk and here == total and start >= 0 and at + 22 + comment <= len(self.blob):
                self.zip_ends[start] = (at, at + 22 + comment, total)


def _png(b: bytes, at: int, stop_at: int) -> int | None:
    end = at + 8
    first = True
    while end + 12 <= stop_at:
        size, kind = struct.unpack_from(">I4s", b, end)
        stop = end + 12 + size
        if stop > stop_at or (first and (kind != b"IHDR" or size != 13)):
            return None
        if zlib.crc32(b[end + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None
        end, first = stop, False
        if kind == b"IEND":
            return end - at
    return None


def _gif(b: bytes, at: int, stop_at: int) -> int | None:
    def blocks(p: int) -> int:
        while p < stop_at and b[p]:
            p += b[p] + 1
        return p + 1

    if at + 13 > stop_at:
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    images = 0
    while p < stop_at:
        if b[p] == 0x3B:
            return p + 1 - at if images else None
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < stop_at:
            local = b[p + 9]
            p = blocks(p + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
            images += 1
        else:
            return None
    return None


def _jpeg(b: bytes, at: int, stop_at: int) -> int | None:
    p = at + 2
    frame = False
    while p + 4 <= stop_at:
        if b[p] != 0xFF:
            return None
        marker = b[p + 1]
        if marker == 0xFF:
            p += 1
        elif marker == 0xD9:
            return p + 2 - at if frame else None
        elif marker in (0x01, *range(0xD0, 0xD8)):
            p += 2
        else:
            size = struct.unpack_from(">H", b, p + 2)[0]
            if size < 2 or p + 2 + size > stop_at:
                return None
            frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
            p += 2 + size
            if marker == 0xDA:  # entropy-coded data up to the next marker that is no stuffing and no restart
                while p + 1 < stop_at and (b[p] != 0xFF or b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                    p += 1
    return p + 2 - at if frame and p + 2 <= stop_at and b[p : p + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int, stop_at: int) -> int | None:
    if at + 54 > stop_at:
        return None
    size, reserved, pixels, header, width, height, planes, depth, packing = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if reserved or planes != 1 or header not in (40, 56, 108, 124) or depth not in (1, 4, 8, 16, 24, 32):
        return None
    if width <= 0 or not height or size > stop_at - at or not 14 + header <= pixels <= size:
        return None
    stride = (width * depth + 31) // 32 * 4
    return size if packing or pixels + stride * abs(height) <= size else None


def _riff(b: bytes, at: int, stop_at: int) -> int | None:
    if at + 12 > stop_at or b[at + 8 : at + 12] not in RIFF_FORMS:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > stop_at:
        return None
    p = at + 12
    while p + 8 <= end:
        p += 8 + struct.unpack_from("<I", b, p + 4)[0]
        p += (p - at) & 1
    return end - at if p in (end, end + 1) else None


def _pdf(signs: Signs, at: int, stop_at: int) -> int | None:
    """To the last end mark before the next PDF whose startxref points to a table or an object; if there is none, to the first one after."""
    b, ends = signs.blob, signs.pdf_ends
    following = bisect_left(signs.pdf_starts, at + 1)
    bound = signs.pdf_starts[following] if following < len(signs.pdf_starts) else stop_at

    def points_back(end: int) -> bool:
        found = re.search(rb"startxref\s+(\d{1,12})\s+$", b[max(at, end - 64) : end])
        return bool(found) and re.match(rb"xref|\d+ \d+ obj", b[at + int(found[1]) : min(end, at + int(found[1]) + 32)]) is not None

    first, middle, last = bisect_left(ends, at), bisect_left(ends, min(bound, stop_at)), bisect_left(ends, stop_at - 4)
    order = chain(range(middle - 1, first - 1, -1), range(middle, last))
    end = next((ends[k] for k in order if ends[k] + 5 <= stop_at and points_back(ends[k])), None)
    return None if end is None else end + 5 - at


def _gzip(b: bytes, at: int, stop_at: int) -> int | None:
    if at + 18 > stop_at or b[at + 3] & 0xE0:
        return None
    inflate = zlib.decompressobj(31)
    try:
        for p in range(at, stop_at, 1 << 16):
            inflate.decompress(b[p : min(p + (1 << 16), stop_at)])
            if inflate.eof:
                return min(p + (1 << 16), stop_at) - len(inflate.unused_data) - at
    except zlib.error:
        return None
    return None


def _ogg(b: bytes, at: int, stop_at: int) -> int | None:
    p = at
    while b[p : p + 5] == b"OggS\0" and p + 27 <= stop_at:
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > stop_at:
            return None
        last = b[p + 5] & 4
        p += size
        if last:
            return p - at
    return None


def _crc_table(polynomial: int, bits: int) -> list[int]:
    out = []
    for value in range(256):
        r = value << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ polynomial if r >> (bits - 1) else r << 1) & (1 << bits) - 1
        out.append(r)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(b: bytes, at: int, stop_at: int) -> tuple[int, int] | None:
    """The end of a frame's header and its samples, if a frame starts here."""
    if at + 6 > stop_at or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 3] & 1:
        return None
    size, rate = b[at + 2] >> 4, b[at + 2] & 15
    lead = b[at + 4]
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if lead >> (6 - k) == (1 << (k + 2)) - 2), -1)
    if not size or rate == 15 or more < 0 or (b[at + 3] >> 4) > 10:
        return None
    p = at + 5 + more
    wide = {6: 1, 7: 2}.get(size, 0)
    samples = int.from_bytes(b[p : p + wide], "big") + 1 if wide else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    p += wide + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= stop_at:
        return None
    crc = 0
    for x in b[at:p]:
        crc = _CRC8[crc ^ x]
    return (p + 1, samples) if crc == b[p] else None


def _flac(b: bytes, at: int, stop_at: int) -> int | None:
    p = at + 4
    first, total = True, 0
    while True:
        if p + 4 > stop_at:
            return None
        kind, size, last = b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big"), b[p] & 0x80
        if kind > 6 or (first and (kind or size != 34)) or p + 4 + size > stop_at:
            return None
        if first:
            total = int.from_bytes(b[p + 17 : p + 22], "big") & (1 << 36) - 1
        p, first = p + 4 + size, False
        if last:
            break
    seen = 0
    while (frame := _flac_frame(b, p, stop_at)) and not (total and seen >= total):
        crc, q, begin = 0, p, frame[0]
        done = seen + frame[1] >= total if total else False
        while q < stop_at:
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[q]]
            q += 1
            # of a sound frame the checksum is zero once its own two bytes are read
            if not crc and q > begin + 2 and (done or q == stop_at or not total or _flac_frame(b, q, stop_at)):
                break
        else:
            return None
        if crc:
            return None
        p, seen = q, seen + frame[1]
    return p - at if seen and seen >= total else None


def _mp4(b: bytes, at: int, stop_at: int) -> int | None:
    p, kinds = at, []
    while p + 8 <= stop_at:
        size, kind = struct.unpack_from(">I4s", b, p)
        head = 8
        if size == 1 and p + 16 <= stop_at:
            size, head = struct.unpack_from(">Q", b, p + 8)[0], 16
        elif size == 0:
            size = stop_at - p
        if size < head or p + size > stop_at or kind not in MP4_BOXES or (not kinds) != (kind == b"ftyp"):
            break
        if kind == b"moov" and not _boxes(b, p + head, p + size):
            break
        kinds.append(kind)
        p += size
    return p - at if {b"moov", b"mdat", b"moof"} & {*kinds} else None


def _boxes(b: bytes, p: int, end: int) -> bool:
    """Whether boxes fill a box to its end."""
    while p + 8 <= end and (size := struct.unpack_from(">I", b, p)[0]) >= 8:
        p += size
    return p == end


def _zip(signs: Signs, at: int, stop_at: int) -> int | None:
    """By the directory whose end says that it starts here; the entries and the local heads they name are walked."""
    b = signs.blob
    if at not in signs.zip_ends:
        return None
    directory_end, end, entries = signs.zip_ends[at]
    size, offset = struct.unpack_from("<II", b, directory_end + 12)
    p = at + offset
    for _ in range(entries):
        if p + 46 > directory_end or b[p : p + 4] != b"PK\x01\x02":
            return None
        packed = struct.unpack_from("<I", b, p + 20)[0]
        name, extra, comment = struct.unpack_from("<HHH", b, p + 28)
        local = at + struct.unpack_from("<I", b, p + 42)[0]
        if b[local : local + 4] != b"PK\x03\x04" or local + 30 + packed > at + offset:
            return None
        p += 46 + name + extra + comment
    return end - at if entries and p == directory_end and end <= stop_at else None


def _plain(validator: Callable[[bytes, int, int], int | None]) -> Callable[[Signs, int, int], int | None]:
    return lambda signs, at, stop_at: validator(signs.blob, at, stop_at)


VALIDATORS = {
    "image/png": _plain(_png), "image/gif": _plain(_gif), "image/jpeg": _plain(_jpeg), "image/bmp": _plain(_bmp), "riff": _plain(_riff),
    "application/pdf": _pdf, "application/gzip": _plain(_gzip), "audio/ogg": _plain(_ogg), "audio/flac": _plain(_flac), "video/mp4": _plain(_mp4),
    "application/zip": _zip,
}


def carve(blob: bytes) -> list[Item]:
    """Each valid object, by offset; those inside another one end where it ends, and name it."""
    signs, found, open_items = Signs(blob), [], []
    for at, kind in signs.hits:
        while open_items and found[open_items[-1]].offset + found[open_items[-1]].length <= at:
            open_items.pop()
        inside = open_items[-1] if open_items else -1
        if inside >= 0 and found[inside].offset == at:
            continue  # two formats at one place
        stop_at = found[inside].offset + found[inside].length if inside >= 0 else len(blob)
        if (size := VALIDATORS[kind](signs, at, stop_at)) is not None:
            open_items.append(len(found))
            found.append(Item(RIFF_FORMS[blob[at + 8 : at + 12]] if kind == "riff" else kind, at, size, inside))
    return found


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


#: The types that `store` writes, by the checksum of the payload.
STORED = ("audio/wav", "image/bmp", "image/png", "application/zip")


def store(payload: bytes) -> bytes:
    """The payload, a multiple of ROW bytes, as 8-bit samples: sound, bitmap, PNG, or sound in an archive, as its checksum decides."""
    kind, rows = STORED[zlib.crc32(payload) % len(STORED)], len(payload) // ROW
    if kind in ("audio/wav", "application/zip"):
        head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
        wav = b"RIFF" + struct.pack("<I", 4 + len(head) + len(payload)) + b"WAVE" + head + payload
        if kind == "audio/wav":
            return wav
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            archive.writestr(zipfile.ZipInfo("payload.wav"), wav)  # with a fixed date
        return out.getvalue()
    if kind == "image/bmp":
        palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
        start = 54 + len(palette)
        head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(payload), 0, start, 40, ROW, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
        return head + palette + payload
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples(blob: bytes, kind: str) -> bytes:
    """The 8-bit samples of a carved object that `store` can have written."""
    if kind == "audio/wav":
        p = 12
        while blob[p : p + 4] != b"data":
            p += 8 + struct.unpack_from("<I", blob, p + 4)[0]
        return blob[p + 8 : p + 8 + struct.unpack_from("<I", blob, p + 4)[0]]
    if kind == "image/bmp":
        start, (width, height) = struct.unpack_from("<I", blob, 10)[0], struct.unpack_from("<ii", blob, 18)
        return blob[start : start + width * abs(height)]
    if kind == "image/png":
        p, packed, width = 8, b"", struct.unpack_from(">I", blob, 16)[0]
        while p < len(blob):
            size = struct.unpack_from(">I", blob, p)[0]
            packed += blob[p + 8 : p + 8 + size] if blob[p + 4 : p + 8] == b"IDAT" else b""
            p += 12 + size
        lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)
        if lines[:, 0].any():
            raise ValueError("only unfiltered rows can be read")
        return lines[:, 1:].tobytes()
    raise ValueError(f"no sample reader for {kind}")


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stored media object: doc_id, n_bytes (of the unpadded text), declared, media. The declared type is one of STORED by
    other bits of the checksum than the ones that choose the format, so it is wrong for most rows."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]
        payloads = [b + b" " * (max(1, -(-len(b) // ROW)) * ROW - len(b)) for b in raw]
        declared = [STORED[(zlib.crc32(p) >> 16) % len(STORED)] for p in payloads]
        return pa.record_batch(
            [batch.column("doc_id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(declared, pa.string()), pa.array(map(store, payloads), pa.binary())],
            ["doc_id", "n_bytes", "declared", "media"],
        )

    return map_batches(id_and_text(docs, id_col, text_col), encode, "doc_id long, n_bytes long, declared string, media binary")


def type_of(items: list[Item]) -> str:
    return next((x.type for x in items if x.offset == 0), UNKNOWN)


def sniff_media(df: DataFrame, id_col: str, media_col: str, declared_col: str) -> DataFrame:
    """doc_id, declared, detected (type of the object at offset 0), corrected (whether they differ), items (all carved
    objects as type, offset, length, inside)."""
    item = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inside", pa.int32())]))

    def sniff(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = [carve(b or b"") for b in batch.column("media").to_pylist()]
        kinds, declared = list(map(type_of, items)), batch.column("declared").to_pylist()
        return pa.record_batch(
            [
                batch.column("doc_id"), batch.column("declared"), pa.array(kinds, pa.string()), pa.array([a != b for a, b in zip(declared, kinds)], pa.bool_()),
                pa.array([[x._asdict() for x in own] for own in items], item),
            ],
            ["doc_id", "declared", "detected", "corrected", "items"],
        )

    own = df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"), F.col(declared_col).alias("declared"))
    return map_batches(own, sniff, "doc_id long, declared string, detected string, corrected boolean, items array<struct<type:string,offset:long,length:long,inside:int>>")


DIGEST = {
    "doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string",
    "feature": "string", "declared": "string", "detected": "string", "corrected": "boolean", "items": "string",
}


def digest_media(df: DataFrame) -> DataFrame:
    """For rows of `encode_media`: sniffs the stored bytes, carves the objects, reads the samples back from the innermost one and describes
    all. `items` lists type@offset+length<container; `feature` is detected type, number of items, mean sample and distinct samples."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for media, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist()):
            items = carve(media)
            kind, at, size, _ = next(x for x in items if x.type in STORED[:3])
            payload = samples(media[at : at + size], kind)
            counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            mean, detected = int((counts * np.arange(256)).sum()) / len(payload), type_of(items)
            feature = f"type={detected};items={len(items)};mean={mean:.4f};distinct={np.count_nonzero(counts)}"
            listed = ",".join(f"{x.type}@{x.offset}+{x.length}<{x.inside}" for x in items)
            whole = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()
            out.append((len(payload), *whole, feature, declared, detected, declared != detected, listed))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.bool_(), pa.string())
        return pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*out), types))], list(DIGEST))

    small_batches(df.sparkSession)
    return map_batches(df, digest, ", ".join(f"{name} {kind}" for name, kind in DIGEST.items()))
