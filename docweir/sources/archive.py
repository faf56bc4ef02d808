"""ZIP archives: the directory without unpacking, and members as streams that can stop early."""

from __future__ import annotations

import codecs
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

END, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
END_WITHIN = 65_557
#: Bytes of a member worked on at a time; bytes that a member may unpack to where it is read as a whole.
CHUNK, MEMBER = 64 * 1024, 256 * 1024 * 1024


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    local: int


def directory(data: bytes) -> list[Member]:
    """The central directory, up to the first entry that is none; empty if there is no directory."""
    end = data.rfind(END, max(0, len(data) - END_WITHIN))
    if end < 0 or end + 22 > len(data):
        return []
    at = struct.unpack_from("<I", data, end + 16)[0]
    out: list[Member] = []
    while at + 46 <= len(data) and data[at : at + 4] == CENTRAL:
        method, = struct.unpack_from("<H", data, at + 10)
        packed, size, n, extra, note = struct.unpack_from("<IIHHH", data, at + 20)
        local, = struct.unpack_from("<I", data, at + 42)
        out.append(Member(data[at + 46 : at + 46 + n].decode("utf-8", "replace"), method, packed, size, local))
        at += 46 + n + extra + note
    return out


class Archive:
    """Members by name; reading one counts the bytes it unpacks."""

    def __init__(self, data: bytes):
        self.data = data
        self.members = {m.name: m for m in reversed(directory(data))}
        self.unpacked = 0

    def _range(self, name: str) -> tuple[int, Member] | None:
        m = self.members.get(name)
        if m is None or m.local + 30 > len(self.data) or self.data[m.local : m.local + 4] != LOCAL:
            return None
        n, extra = struct.unpack_from("<HH", self.data, m.local + 26)
        start = m.local + 30 + n + extra
        return (start, m) if start + m.packed <= len(self.data) else None

    def chunks(self, name: str) -> Iterator[bytes] | None:
        """The member's bytes as they are unpacked, or None if there is no such member or its place is out of range."""
        found = self._range(name)
        if found is None or found[1].method not in (0, 8):
            return None
        return self._chunks(*found)

    def _chunks(self, start: int, m: Member) -> Iterator[bytes]:
        unpack = zlib.decompressobj(-15) if m.method == 8 else None
        for lo in range(start, start + m.packed, CHUNK):
            part = self.data[lo : min(lo + CHUNK, start + m.packed)]
            while part:
                got = unpack.decompress(part, CHUNK) if unpack else part
                part = unpack.unconsumed_tail if unpack else b""
                self.unpacked += len(got)
                if got:
                    yield got
        if unpack and (got := unpack.flush()):
            self.unpacked += len(got)
            yield got

    def read(self, name: str, most: int = MEMBER) -> bytes | None:
        """A whole member, or None if it is not there or damaged; one that unpacks to more than `most` bytes is refused."""
        found = self.chunks(name)
        if found is None:
            return None
        out, size = [], 0
        try:
            for part in found:
                size += len(part)
                if size > most:
                    raise ValueError("MEMBER_TOO_LARGE")
                out.append(part)
        except zlib.error:
            return None
        return b"".join(out)

    def text(self, name: str) -> str | None:
        got = self.read(name)
        return None if got is None else got.decode("utf-8", "replace").removeprefix("\ufeff")


class TextPull:
    """Text of a member, decoded as it comes; `more` extends what is pending."""

    def __init__(self, chunks: Iterator[bytes]):
        self._chunks, self._decode, self.pending = chunks, codecs.getincrementaldecoder("utf-8")("replace").decode, ""

    def more(self) -> bool:
        part = next(self._chunks, None)
        if part is None:
            return False
        self.pending += self._decode(part)
        return True


def pack_files(files: list[tuple[str, bytes]]) -> bytes:
    """A ZIP with fixed timestamps, so that equal files give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()
