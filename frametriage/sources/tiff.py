"""TIFF directories by ranged reads: header, IFD0, Exif and GPS directories, and the values that are asked for."""

from __future__ import annotations

import dataclasses
import struct
from typing import BinaryIO

from .. import errors
from ..errors import TriageError

MOST_ENTRIES = 256
MOST_STEPS = 32
MOST_VALUE = 8 * 1024
#: Bytes of a value by field type code.
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
ASCII, SHORT, LONG, RATIONAL, UNDEFINED, SSHORT, SLONG, SRATIONAL, IFD = 2, 3, 4, 5, 7, 8, 9, 10, 13
# Tags.
EXIF_IFD, GPS_IFD, COMPRESSION = 0x8769, 0x8825, 0x0103
STRIP_OFFSETS, STRIP_BYTES, JPEG_START, JPEG_LENGTH = 0x0111, 0x0117, 0x0201, 0x0202
#: Fields of the metadata: how they are read, and their tags, the first present one of which counts.
FIELDS = {
    "make": ("text", [0x010F]),
    "model": ("text", [0x0110]),
    "software": ("text", [0x0131]),
    "capture_raw": ("text", [0x9003, 0x0132]),
    "exposure_s": ("float", [0x829A]),
    "f_number": ("float", [0x829D]),
    "focal_mm": ("float", [0x920A]),
    "exposure_bias": ("float", [0x9204]),
    "iso": ("u16", [0x8827]),
    "orientation": ("u16", [0x0112]),
    "compression": ("u16", [COMPRESSION]),
    "samples": ("u16", [0x0115]),
    "metering": ("u16", [0x9207]),
    "program": ("u16", [0x8822]),
    "flash": ("u16", [0x9209]),
    "white_balance": ("u16", [0xA403]),
    "photometric": ("u16", [0x0106]),
    "width": ("u16", [0xA002, 0x0100]),
    "height": ("u16", [0xA003, 0x0101]),
}


@dataclasses.dataclass(frozen=True)
class Entry:
    tag: int
    type: int | None
    count: int
    offset: int
    inline: bytes

    @property
    def size(self) -> int:
        return WIDTHS.get(self.type, 0) * self.count


class TiffFile:
    """Reads ranges of an open file and counts the bytes."""

    def __init__(self, file: BinaryIO, name: str):
        self.file, self.name = file, name
        self.size = file.seek(0, 2)
        file.seek(0)
        head = file.read(8)
        if len(head) < 8:
            raise TriageError(errors.NOT_TIFF, name, f"{len(head)} bytes")
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if self.order is None:
            raise TriageError(errors.NOT_TIFF, name, f"starts with {head[:2].hex()}")
        version, self.first = struct.unpack(f"{self.order}HI", head[2:])
        if version != 42:
            raise TriageError(errors.BIG_TIFF, name, f"version {version}")
        self.bytes_read = 8
        self.exif: list[Entry] = []
        self.gps: list[Entry] = []

    def within(self, offset: int, n: int) -> None:
        if offset >= self.size or offset + n > self.size:
            raise TriageError(errors.BAD_IFD, self.name, f"{n} bytes at {offset} of {self.size}")

    def read(self, offset: int, n: int) -> bytes:
        self.within(offset, n)
        self.file.seek(offset)
        data = self.file.read(n)
        if len(data) < n:
            raise TriageError(errors.BAD_IFD, self.name, f"ends at {offset + len(data)}")
        self.bytes_read += n
        return data

    def directory(self, offset: int, visited: set[int], step: int) -> list[Entry]:
        if step > MOST_STEPS:
            raise TriageError(errors.IFD_LIMIT, self.name, f"{step} directories")
        if offset in visited:
            raise TriageError(errors.BAD_IFD, self.name, f"directory {offset} again")
        visited.add(offset)
        (n,) = struct.unpack(f"{self.order}H", self.read(offset, 2))
        if n > MOST_ENTRIES:
            raise TriageError(errors.BAD_IFD, self.name, f"{n} entries")
        if not n:
            return []
        self.within(offset + 2, 12 * n + 4)  # the pointer to the next directory must be there, but is not followed
        table = self.read(offset + 2, 12 * n)
        form = struct.Struct(f"{self.order}HHI4s")
        pointer = struct.Struct(f"{self.order}I")
        return [Entry(tag, kind if kind in WIDTHS else None, count, *pointer.unpack(inline), inline) for tag, kind, count, inline in form.iter_unpack(table)]

    def load(self) -> None:
        """IFD0, and from it the Exif and GPS directories, without those if they are missing or broken."""
        visited: set[int] = set()
        self.within(self.first, 1)
        self.main = self.directory(self.first, visited, 1)
        for step, (name, tag) in enumerate((("exif", EXIF_IFD), ("gps", GPS_IFD)), 2):
            own = next((e for e in self.main if e.tag == tag), None)
            offset = None if own is None else self.u32(own)
            if offset and offset < self.size:
                try:
                    setattr(self, name, self.directory(offset, visited, step))
                except TriageError as e:
                    if e.label not in (errors.BAD_IFD, errors.IFD_LIMIT):
                        raise

    def find(self, tags: list[int]) -> Entry | None:
        return next((e for t in tags for ifd in (self.exif, self.main) for e in ifd if e.tag == t), None)

    def value(self, e: Entry) -> bytes:
        if e.type is None:
            raise TriageError(errors.BAD_IFD, self.name, f"tag {e.tag:#06x} of unknown type")
        if e.size > MOST_VALUE:
            raise TriageError(errors.BAD_IFD, self.name, f"tag {e.tag:#06x} has {e.size} bytes")
        return e.inline[: e.size] if e.size <= 4 else self.read(e.offset, e.size)

    def _number(self, e: Entry, signed: bool) -> int | None:
        width = WIDTHS[e.type]
        data = self.value(e)[:width]
        form = {2: "h" if signed else "H", 4: "i" if signed else "I"}[width]
        return struct.unpack(self.order + form, data)[0] if len(data) == width else None

    def u16(self, e: Entry) -> int | None:
        """Longer ones saturate."""
        n = self._number(e, signed=False) if e.type in (SHORT, SSHORT, LONG, SLONG, IFD) else None
        return n if n is None else min(n, 0xFFFF)

    def u32(self, e: Entry) -> int | None:
        return self._number(e, signed=False) if e.type in (SHORT, SSHORT, LONG, SLONG, IFD) else None

    def float(self, e: Entry) -> float | None:
        """A rational has an unsigned denominator; null if that is 0."""
        if e.type in (RATIONAL, SRATIONAL):
            data = self.value(e)[:8]
            if len(data) < 8:
                return None
            a, b = struct.unpack(f"{self.order}{'i' if e.type == SRATIONAL else 'I'}I", data)
            return a / b if b else None
        n = self._number(e, signed=True) if e.type == SSHORT else self.u32(e)
        return n if n is None else float(n)

    def text(self, e: Entry) -> str | None:
        if e.type not in (ASCII, UNDEFINED):
            return None
        return self.value(e).split(b"\0", 1)[0].decode(errors="replace").strip() or None

    def field(self, name: str):
        kind, tags = FIELDS[name]
        e = self.find(tags)
        return None if e is None else getattr(self, kind)(e)

    def metadata(self) -> dict:
        out = {name: self.field(name) for name in FIELDS}
        out["strip_bytes"] = None
        if out["compression"] == 7 and (e := self.find([STRIP_BYTES])) is not None:
            out["strip_bytes"] = self.u32(e)
        return out

    def preview(self) -> tuple[int, int, str] | None:
        """Offset, length and source of the embedded JPEG: the interchange tags, else the first strip if compression is 7."""
        for start, length, source in ((JPEG_START, JPEG_LENGTH, "JPEGInterchangeFormat"), (STRIP_OFFSETS, STRIP_BYTES, "StripOffsets")):
            if source == "StripOffsets":
                e = self.find([COMPRESSION])
                if e is None or self.u16(e) != 7:
                    return None
            a, b = self.find([start]), self.find([length])
            if a is not None and b is not None:
                at, n = self.u32(a), self.u32(b)
                if at and n and at < self.size and at + n <= self.size:
                    return at, n, source
        return None
