"""Tag directories of JPEG files, decoded inside tasks (no Spark here).

A JPEG file is a list of segments (marker, body); the first body that starts with ``Exif`` holds a TIFF
block. A directory in there is a table of 12-byte records, read as one array and decoded by type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Fixed values of the file formats: markers without a body, start of the image data, the segment that
# holds Exif and its title, byte orders, types and the tags that point to other directories.
STANDALONE = {0x01, *range(0xD0, 0xDA)}
IMAGE_DATA, APPLICATION_1, TITLE = 0xDA, 0xE1, b"Exif\0\0"
BYTE_ORDER = {b"II": "<", b"MM": ">"}
ASCII, SHORT, LONG = 2, 3, 4
POINTERS = {"exif": 0x8769, "gps": 0x8825}


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and body of every whole segment before the image data."""
    rest = data[2:] if data.startswith(b"\xff\xd8") else b""
    while len(rest) > 3 and rest[0] == 0xFF:
        marker, length = rest[1], int.from_bytes(rest[2:4], "big")
        if marker in STANDALONE:
            length = 0
        elif marker == IMAGE_DATA or not 2 <= length <= len(rest) - 2:
            return
        else:
            yield marker, rest[4 : length + 2]
        rest = rest[length + 2 :]


class Block:
    """A TIFF block: numbers in its byte order, and directories."""

    def __init__(self, data: bytes):
        self.data, self.order = data, BYTE_ORDER.get(data[:2], "")
        self.record = np.dtype([("tag", "u2"), ("type", "u2"), ("count", "u4"), ("value", "V4")]).newbyteorder(self.order or "=")

    def number(self, raw: bytes, size: int) -> int:
        return int(np.frombuffer(raw[:size], f"{self.order}u{size}")[0])

    def valid(self) -> bool:
        return bool(self.order) and len(self.data) >= 8 and self.number(self.data[2:], 2) == 42

    def directory(self, offset: int) -> dict[int, tuple[str | None, int | None]]:
        """tag -> (text, number): a text, a single number, or nothing but the presence."""
        if offset + 2 > len(self.data):
            return {}
        body = self.data[offset + 2 :][: 12 * self.number(self.data[offset:], 2)]
        found = {}
        for record in np.frombuffer(body[: len(body) // 12 * 12], self.record):
            value = self.decoded(int(record["type"]), int(record["count"]), record["value"].tobytes())
            if value is not None:
                found[int(record["tag"])] = value
        return found

    def decoded(self, kind: int, count: int, raw: bytes) -> tuple[str | None, int | None] | None:
        """None where a text is empty or lies outside the block."""
        if kind in (SHORT, LONG) and count == 1:
            return None, self.number(raw, 2 if kind == SHORT else 4)
        if kind != ASCII:
            return None, None
        place = self.number(raw, 4)
        letters = raw[:count] if count <= 4 else self.data[place : place + count]
        text = letters.decode("latin-1").rstrip("\0").strip()
        return (text, None) if text and len(letters) == count else None


def read_tags(data: bytes) -> list[tuple[str, int, str | None, int | None]]:
    """(directory, tag, text, number) of the main, EXIF and GPS directories; [] if malformed."""
    block = Block(next((b[len(TITLE) :] for m, b in segments(data) if m == APPLICATION_1 and b.startswith(TITLE)), b""))
    if not block.valid():
        return []
    main = block.directory(block.number(block.data[4:], 4))
    pointed = {name: main[tag][1] for name, tag in POINTERS.items() if main.get(tag, (None, None))[1] is not None}
    tables = {"ifd0": main} | {name: block.directory(offset) for name, offset in pointed.items()}
    return [(name, tag, *value) for name, table in tables.items() for tag, value in table.items()]


# Segments that hold metadata (application data but the first kind, comments) and the end marker.
METADATA, END = {*range(0xE1, 0xF0), 0xFE}, 0xD9


def without_metadata(data: bytes) -> bytes:
    """The file without metadata segments; ``ValueError`` where it is no JPEG file or ends too early."""
    if not data.startswith(b"\xff\xd8"):
        raise ValueError("The image could not be decoded.")
    kept, at = [data[:2]], 2
    while at + 1 < len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == END:
            return b"".join([*kept, data[at : at + 2]])
        if marker == IMAGE_DATA:
            if data.endswith(bytes((0xFF, END))):
                return b"".join([*kept, data[at:]])
            break
        size = 2 if marker in STANDALONE else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if at + size > len(data) or size < 2:
            break
        if marker not in METADATA:
            kept.append(data[at : at + size])
        at += size
    raise ValueError("The image ends too early.")
